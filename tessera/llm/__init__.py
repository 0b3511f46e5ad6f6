"""Operators for building language-model training data out of large text tables."""
