"""Keyed, append-only time-series streams on PySpark."""
