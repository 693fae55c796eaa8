"""Document review, retrieval and corpus processing on Spark DataFrames."""
