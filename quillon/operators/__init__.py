"""DataFrame operators: curation, data sets, metrics, statistics, ranking and series."""
