"""Document ingestion, hybrid retrieval and corpus building on Spark DataFrames."""
