"""Training-data operators (numbered 1 to 10) on Spark DataFrames."""
