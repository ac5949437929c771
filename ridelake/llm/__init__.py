"""Operators for preparing training text: formatting, scoring, deduplication, packing, archives."""
