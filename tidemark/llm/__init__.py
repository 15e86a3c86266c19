"""Operators for large training-data pipelines; nothing else in tidemark imports this package."""
