"""loomspark.plans."""
