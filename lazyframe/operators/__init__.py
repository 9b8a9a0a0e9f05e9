"""Verbs on tables, groups and arrays."""
