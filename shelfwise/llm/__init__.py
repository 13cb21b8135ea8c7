"""Operators for training-data pipelines over document, page and embedding tables.

Nothing outside this subpackage imports it.
"""
