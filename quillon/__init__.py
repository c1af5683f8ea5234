"""Spark-first engine for evaluation, retrieval and training-data tables."""
