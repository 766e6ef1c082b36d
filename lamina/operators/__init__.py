"""Relational operators: one module each."""
