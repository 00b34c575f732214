"""Operators: pure functions from DataFrames to DataFrames. Clocks and draws are arguments."""
