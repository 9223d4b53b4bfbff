"""Matching, explaining, correlating and merging, on batch DataFrames."""
