"""Vertex programs and the loop that runs them."""
