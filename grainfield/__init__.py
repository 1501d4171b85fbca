"""grainfield: web-harvest analytics as Spark DataFrame, SQL and Structured Streaming operators."""
