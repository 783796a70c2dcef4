"""Relational, spatial, graph and clustering operators on DataFrames."""
