"""Weighted graph pattern mining on Spark DataFrames."""
