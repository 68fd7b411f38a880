"""Fixture views and the registry of queries."""
