"""Operators of a training-data pipeline over large text corpora.

Nothing outside this package imports it. ``queries.py`` registers the
operators for the driver contract.
"""
