"""Operators of a training-data pipeline over large text tables.

Nothing else in the library imports this subpackage.  Every operator reads only the columns
that it names, so that further columns of its input never clash with its own.
"""
