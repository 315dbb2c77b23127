"""Sparse-matrix analytics as Spark jobs."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
