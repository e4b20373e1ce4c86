"""Search-relevance and training-data analytics on Spark."""
