"""Expressions, column selectors and scalar functions."""
