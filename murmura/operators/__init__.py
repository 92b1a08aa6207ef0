"""Operators: DataFrame in, DataFrame out (or a small result record)."""
