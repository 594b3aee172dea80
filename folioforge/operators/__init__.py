"""Ordered, keyed and document operators on DataFrames."""
