"""Stateful correlation in arrival order, for batches and streams."""
