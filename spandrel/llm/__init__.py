"""Operators for preparing training data for language models.

Every module holds one operator with its own general interface and one thin
query ``opN_<name>``.  Nothing outside this subpackage imports it.
"""
