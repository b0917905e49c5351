"""Operators on texts for training. Nothing outside this package imports it."""
