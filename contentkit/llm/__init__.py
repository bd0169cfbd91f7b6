"""Operators for preparing language-model training data at scale.

Each module holds one operator; ``queries`` registers them.  Nothing else in the library imports
this subpackage.  All operators take and return DataFrames, tolerate nulls, empty and very long
texts, ties, repeated rows, empty tables and extra columns, and cut lineage only by tables written
to the shared folder of the session (``storage``).
"""
