"""Shared plan shapes: staged tables, size-checked broadcasts, skew-proof joins, dense numbering."""
