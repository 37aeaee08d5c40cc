"""Relational and vector operators, DataFrame to DataFrame."""
