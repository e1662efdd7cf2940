"""Operators: DataFrames in, DataFrames out. Nothing here writes."""
