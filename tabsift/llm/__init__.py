"""Operators of a training-data pipeline: one module per operator, all DataFrame to DataFrame.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per operator.
"""
