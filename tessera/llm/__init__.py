"""Operators for preparing language-model training corpora at scale.

Each module holds one operator with a general interface; ``queries`` binds
them to the test tables.  Nothing else in the package imports this folder.
"""
