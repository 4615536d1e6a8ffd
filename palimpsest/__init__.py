"""Versioned table archive and data operators on PySpark."""
