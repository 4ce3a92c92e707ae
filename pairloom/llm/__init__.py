"""Operators for preparing training data: text, pages, vectors and conversations at scale."""
