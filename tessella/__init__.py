"""Tessella: relational code analytics and corpus processing on Spark DataFrames."""
