"""loomspark: a PySpark engine for agent-session evidence and training-data preparation."""

__version__ = "0.1.0"
