"""loomspark.operators."""
