"""Sigmill: signal and sequence feature analytics on Spark DataFrames."""
