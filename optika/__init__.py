"""Choice-evaluation analytics on Spark."""
