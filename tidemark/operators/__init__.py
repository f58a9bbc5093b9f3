"""Operators on DataFrames: features, detection, security, graph, incidents, serving."""
