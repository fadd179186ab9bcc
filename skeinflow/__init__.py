"""Nested, ordered, column-oriented analytics on Spark."""
