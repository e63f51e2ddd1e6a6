"""Operators for large text corpora that feed language-model training.

Each module holds one operator; ``queries`` registers one query per operator
on the given tables.  Nothing else in the library imports this subpackage.
"""
