"""Vector similarity search and proximity graphs on Spark DataFrames."""
