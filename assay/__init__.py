"""Evaluation analytics on Spark DataFrames."""
