"""Operators for training-data pipelines: one module per operator, helpers beside them.

Every operator takes and returns DataFrames of any number of rows. Nulls, empty and very long
texts, repeated rows, empty tables and extra columns have a defined result, stated in each
operator's docstring. Nothing else in the library imports this package.
"""
