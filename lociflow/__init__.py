"""Interval, sequence, coverage and expression analytics on Spark DataFrames."""
