"""Object-inventory analytics on Spark DataFrames."""
