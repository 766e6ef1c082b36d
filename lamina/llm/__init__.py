"""Operators for training data: percentiles, distinct counts, packing, leakage, residue."""
