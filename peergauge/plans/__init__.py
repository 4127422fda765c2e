"""Named queries: the operators bound to concrete tables."""
