"""Mesh, join, spectrum, catalog and ensemble operators."""
