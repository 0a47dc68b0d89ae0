"""Spark-first analytics for code history, diffs, retrieval, symbol graphs and review findings."""

__version__ = "0.1.0"
