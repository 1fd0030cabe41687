"""Sharded vector search as DataFrames: distances, neighbours, shards, routing, search and attribution."""
