"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries
only where it is present.
"""
