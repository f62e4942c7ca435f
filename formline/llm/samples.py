"""Samples of about a wished number of rows by a share of hashes."""

from __future__ import annotations


def hash_limit(wished: int, count: int) -> int:
    """Signed 64-bit hashes up to this number are about ``wished`` out of ``count`` rows."""
    if wished >= count:
        return (1 << 63) - 1
    return -(1 << 63) + (wished << 64) // count
