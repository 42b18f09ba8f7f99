"""Operators on graphs: access, mutation, aggregation, queries."""
