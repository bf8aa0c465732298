"""Topological analytics on Spark DataFrames: operators, sources, functions, query plans and streams."""
