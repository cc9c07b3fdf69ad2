"""Motion-telemetry analytics on Spark DataFrames, keyed by recording."""
