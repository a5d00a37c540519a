"""Operators for large text corpora: one module per operator, queries in ``queries``."""
