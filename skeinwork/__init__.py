"""Record linkage, text search and temporal evidence over Spark DataFrames."""
