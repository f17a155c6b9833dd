"""Cloud-cost analytics on Spark DataFrames."""
