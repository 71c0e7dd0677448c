"""Timed-attempt competition analytics on Spark DataFrames."""
