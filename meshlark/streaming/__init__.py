"""Iterative state: time steps and relaxation."""
