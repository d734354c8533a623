"""Structured Streaming."""

from recordspark.streaming import windows

__all__ = ["windows"]
