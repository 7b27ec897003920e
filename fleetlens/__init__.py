"""Repository-fleet analytics on Spark DataFrames."""
