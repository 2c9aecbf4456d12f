"""nearfield: vector search and analytics on Spark DataFrames."""
