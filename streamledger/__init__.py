"""A change-stream store and query engine on Spark DataFrames."""
