"""Training-data operators for text corpora on Spark DataFrames."""
