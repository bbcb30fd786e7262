"""Operators: each one returns a lazy DataFrame."""
