"""Label-quality analytics on Spark."""
