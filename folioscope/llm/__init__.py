"""Operators for preparing training text: filtering, deduplication, scoring, scanning and mixing."""
