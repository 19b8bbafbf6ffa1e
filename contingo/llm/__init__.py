"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Queries and their SQL
are collected in ``contingo.llm.queries``.
"""
