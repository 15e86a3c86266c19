"""tidemark: partition-aware data analytics on Spark."""

__version__ = "0.1.0"
