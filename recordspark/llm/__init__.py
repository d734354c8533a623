"""Operators for preparing large training corpora; nothing else in recordspark imports this package."""
