"""Capture analytics and corpus preparation on PySpark."""
