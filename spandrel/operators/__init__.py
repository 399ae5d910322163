"""Relational operators: DataFrames in, a lazily composed DataFrame out."""
