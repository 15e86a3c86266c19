"""Readers of listings, logs, manifests and statements as DataFrames."""
