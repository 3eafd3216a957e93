"""Ranked keyword retrieval over an inverted index kept as four Spark tables."""

from termspire.model import Index, Layout

__all__ = ["Index", "Layout"]
