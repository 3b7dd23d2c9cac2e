"""Territorial vote analytics as PySpark DataFrame operators."""
