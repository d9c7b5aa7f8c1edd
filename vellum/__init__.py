"""Vellum: version-controlled relational tables and analytics on PySpark."""

__version__ = "0.1.0"
