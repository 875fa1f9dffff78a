"""Operators: DataFrame in, DataFrame out, one row per document."""
