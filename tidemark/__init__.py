"""Point-in-time fundamentals analytics on Spark."""
