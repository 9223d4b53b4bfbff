"""Column functions with the rules' own semantics."""
