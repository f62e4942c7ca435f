"""Point-in-time feature and strategy analytics on Spark DataFrames."""
