"""Spark-first building blocks: plans."""
