"""Weighted-digraph field analysis and corpus preparation on Spark DataFrames."""
