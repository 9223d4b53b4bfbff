"""Rules, and their compilation to columns."""
