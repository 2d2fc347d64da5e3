"""Operators on DataFrames: merges, listings, statistics, digests, runs and the queue."""
