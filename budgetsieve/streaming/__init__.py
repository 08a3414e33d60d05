"""Incremental upkeep of an index and of arms, as micro-batches."""
