"""Readers and writers."""

from recordspark.sources import formats

__all__ = ["formats"]
