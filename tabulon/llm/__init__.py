"""Operators for preparing language-model training data.

Each module holds one operator as ``DataFrame -> DataFrame``; ``queries`` adds
the registered queries.  Nothing else in the library imports this subpackage.
"""
