"""loomspark.sources."""
