"""Vertex programs over graphs as DataFrame joins and aggregations."""
