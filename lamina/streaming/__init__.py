"""Incremental front ends of the batch operators."""
