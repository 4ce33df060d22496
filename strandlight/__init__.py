"""Single-molecule footprint and force-trace analytics on Spark SQL."""
