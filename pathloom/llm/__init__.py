"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; it can be deleted and the
rest still works.  Its queries are in :mod:`pathloom.llm.catalog`.
"""
