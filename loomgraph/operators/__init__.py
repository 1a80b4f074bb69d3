"""Operators of the document graph, each a composition of DataFrame operations."""
