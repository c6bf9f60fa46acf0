"""Spark-first engine for dated career records, ego networks and text corpora."""
