"""Reading-annotation analytics on Spark."""
