"""Operators for preparing training text at scale. Nothing else in convan imports this package."""
