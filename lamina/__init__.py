"""Typed merging of drifting files and large-scale data preparation on Spark."""
