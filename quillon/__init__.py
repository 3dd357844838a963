"""quillon: column-privacy analytics on Spark DataFrames."""
