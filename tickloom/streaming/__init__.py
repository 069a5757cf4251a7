"""Streaming of the market-data engine."""
