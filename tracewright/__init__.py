"""Spark-first preparation, scoring and analysis of reasoning traces."""
