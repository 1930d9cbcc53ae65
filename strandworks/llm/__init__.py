"""Operators for large text corpora: each is a DataFrame-to-DataFrame function with its own module.

Nothing else in the library imports this subpackage.
"""
