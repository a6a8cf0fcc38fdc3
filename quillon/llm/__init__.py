"""Training-data operators: language, duplicates, packing, search, chat and toxicity."""
