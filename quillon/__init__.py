"""quillon: catalogue curation, paired evaluation and training-data operators on Spark."""
