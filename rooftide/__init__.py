"""Building-footprint analytics on Spark DataFrames."""
