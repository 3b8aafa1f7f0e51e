"""Operators: each takes panel DataFrames and returns a DataFrame, lazily."""
