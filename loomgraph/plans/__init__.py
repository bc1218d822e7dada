"""Graphs over given tables, and the registered queries."""
