"""Partitioning patterns shared by operators, and the composite report."""
