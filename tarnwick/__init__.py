"""Tarnwick: text retrieval and training-data analytics on PySpark."""
