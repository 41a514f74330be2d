"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Every operator takes and returns DataFrames; ``queries`` holds the
registered queries and their SQL.
"""
