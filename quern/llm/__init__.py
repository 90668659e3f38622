"""Operators for preparing language-model training data.

Nothing else in ``quern`` imports this package; it may be removed as a whole.
"""
