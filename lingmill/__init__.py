"""Text analytics on Spark DataFrames: n-gram language models, string extraction, retrieval, similarity."""
