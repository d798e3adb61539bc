"""Predicates, their compilation to columns, and the SQL subset."""
