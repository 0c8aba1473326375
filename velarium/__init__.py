"""Vector search and benchmark analytics, expressed in Spark."""
