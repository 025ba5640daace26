"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; `queries` registers the `opN_*` queries.
"""
