"""Debate-corpus analytics on Spark DataFrames."""
