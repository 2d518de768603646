"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
