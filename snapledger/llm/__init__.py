"""Operators for building training data, independent of the rest of the package."""
