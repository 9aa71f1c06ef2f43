"""loomspark.streaming."""
