"""Training-data operators: each module takes and returns Spark DataFrames."""
