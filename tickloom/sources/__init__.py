"""Sources of the market-data engine."""
