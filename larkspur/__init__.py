"""Batch hybrid retrieval, agent memory and temporal knowledge on Spark DataFrames."""
