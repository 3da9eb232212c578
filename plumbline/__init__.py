"""Structural analytics and corpus preparation on PySpark."""
