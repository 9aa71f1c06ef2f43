"""loomspark.functions."""
