"""Palimpsest: block-log analytics and corpus preparation on PySpark."""
