"""Relational, graph and statistical operators as DataFrame transformations."""
