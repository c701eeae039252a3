"""Operators of a training-data pipeline over documents, vectors and pages.

Nothing else in the library imports this subpackage. Operators take and
return DataFrames; their registered queries are in ``queries``.
"""
