"""Marketplace search and analytics on Spark DataFrames."""
