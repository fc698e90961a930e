"""Vehicle-bus telemetry analytics on Spark DataFrames."""
