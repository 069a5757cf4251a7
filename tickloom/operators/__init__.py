"""Operators of the market-data engine."""
