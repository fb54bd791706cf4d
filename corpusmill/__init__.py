"""Corpus, retrieval and usage analytics as Spark jobs."""
