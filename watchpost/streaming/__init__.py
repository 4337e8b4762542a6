"""Continuous forms of the batch questions."""
