"""Operators: each is a function DataFrame -> DataFrame (lazy, no UDF)."""
