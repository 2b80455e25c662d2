"""Operators of a training-data pipeline: dedup, scans, formatting, scoring, search, packing, tokens.

Nothing else in the library imports this subpackage; ``registry`` lists its queries and SQL.
"""
