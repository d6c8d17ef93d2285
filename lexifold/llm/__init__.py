"""Operators for building language-model training data.

Each module holds one operator with its own general interface; `queries`
holds the thin registered queries.  Nothing outside this folder imports it.
"""
