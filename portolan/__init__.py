"""Portolan: point-in-time analytics expressed as PySpark DataFrame operations."""
