"""Operators for training text: packing, leaked evaluation passages, truncated texts."""
