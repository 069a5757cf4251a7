"""Plans of the market-data engine."""
