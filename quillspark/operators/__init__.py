"""Operators: DataFrame to DataFrame, lazy, without collects."""
