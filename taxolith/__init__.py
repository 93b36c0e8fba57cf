"""Analytics for short catalogue texts in a category tree, and operators for training-data corpora, as Spark jobs."""
