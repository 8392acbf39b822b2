"""Operators on tick, segment and flag tables."""
