"""Evolving-graph analytics as PySpark DataFrame plans."""
