"""contentkit: turn semi-structured content into a clean, queryable catalog with PySpark."""

__version__ = "0.1.0"
