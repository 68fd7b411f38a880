"""Scalar functions, cosmology and random numbers."""
