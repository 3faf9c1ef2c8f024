"""Retrieval and answer-quality data work as Spark jobs."""
