"""A Spark engine for text corpora and event ledgers."""
