"""Queries by name, decoding and fitting."""
