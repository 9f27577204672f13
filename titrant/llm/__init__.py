"""Operators of a training-data pipeline, and the queries that apply them to whole tables.

Nothing else in the library imports this package.
"""
