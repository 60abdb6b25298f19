"""Operators for preparing training corpora.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame and column names, reads only the columns it names, and returns a
DataFrame; ``queries`` holds the registered queries.
"""
