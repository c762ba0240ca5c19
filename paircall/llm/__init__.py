"""Operators for preparing training data: scoring, filtering, de-duplication, search, mixing and binary output.

Nothing else in the package imports this one. `registry` holds the queries and their SQL.
"""
