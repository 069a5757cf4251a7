"""Market time-series work on Spark: ticks, bars, quality, repair, catalogs, exports and streams."""
