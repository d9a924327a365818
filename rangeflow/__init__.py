"""Spark-first analytics for range-sensor and event streams."""
