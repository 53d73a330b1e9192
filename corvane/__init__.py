"""Retrieval, analytics and corpus preparation as Spark DataFrame programs."""
