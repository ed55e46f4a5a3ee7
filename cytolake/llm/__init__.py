"""Operators for training-data corpora, each built from Spark jobs."""
