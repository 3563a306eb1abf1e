"""Spurline: grid, vector and field-evidence analytics on Spark DataFrames."""
