"""Dynamic heterogeneous graph storage and sampling, expressed on Spark DataFrames."""
