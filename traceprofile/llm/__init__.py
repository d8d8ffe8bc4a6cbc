"""Operators for preparing large text corpora.

Each module holds one operator; ``registry`` names the queries built on them. Nothing
outside this package imports it.
"""
