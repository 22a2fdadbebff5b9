"""Operators for preparing training text: cleaning, duplicate search, filters, packing."""
