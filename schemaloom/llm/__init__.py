"""Operators for building language-model training data.

Nothing else in the library imports this subpackage. Every operator takes DataFrames with at
least ``doc_id`` and ``text``, reads only the columns it names, and works on every row and the
whole of every text.
"""
