"""Bitext curation and token-vector retrieval as Spark jobs."""
