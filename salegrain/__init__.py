"""Event-time sales analytics on Spark."""
