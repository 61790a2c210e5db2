"""Operators: DataFrames of many series in, DataFrames out."""
