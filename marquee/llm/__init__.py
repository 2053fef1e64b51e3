"""Operators for preparing training text: cleaning, deduplication, scoring, mixing, packing."""
