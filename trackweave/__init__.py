"""Tracking and identity analytics on Spark DataFrames."""
