"""Stock and sales analytics on Spark DataFrames."""
