"""Partition planning: what to rebuild, in which order, at what cost."""
