"""Operators for preparing training text: formats, packing, mixing, duplicates, filters."""
