"""Operators: DataFrame in, DataFrame out, or a table change."""
