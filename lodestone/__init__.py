"""A Spark engine for retrieval over text corpora and for preparing training data."""
