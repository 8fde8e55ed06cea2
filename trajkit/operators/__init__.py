"""Operators over trajectory tables: DataFrames in, DataFrames out."""
