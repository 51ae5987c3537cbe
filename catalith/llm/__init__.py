"""Operators for preparing language-model training data (see README, "Corpus operators").

Nothing else in the library imports this subpackage.
"""
