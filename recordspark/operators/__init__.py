"""Operators on whole frames."""

from recordspark.operators import documents, frames, mapping, validation

__all__ = ["documents", "frames", "mapping", "validation"]
