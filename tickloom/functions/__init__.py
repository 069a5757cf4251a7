"""Functions of the market-data engine."""
