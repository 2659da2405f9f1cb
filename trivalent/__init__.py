"""Three-valued catalogue queries on Spark DataFrames."""
