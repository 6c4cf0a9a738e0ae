"""Operators for preparing training text: counting, cleaning, scoring, deduplicating, mixing, formatting."""
