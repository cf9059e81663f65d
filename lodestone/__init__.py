"""Document analytics on Spark DataFrames: retrieval, graphs, metrics and training-data operators."""
