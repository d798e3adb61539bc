"""A typed record store on Spark DataFrames."""
