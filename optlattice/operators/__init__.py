"""Operators on market data and results: DataFrames in, DataFrames out."""
