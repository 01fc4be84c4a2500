"""Operators for large-scale training-text pipelines.

Nothing outside this package imports it.  ``queries.py`` lists the queries and
their oracle SQL; ``__spark_entry__.py`` adds them when the package is there.
"""
