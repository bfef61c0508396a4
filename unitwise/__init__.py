"""Group-level evaluation of datasets and classifiers on Spark DataFrames."""
