"""Reproducible random draws as integer arithmetic on logical keys.

The same key gives the same draw on every run, cluster and engine; nothing depends on
partitioning or task order.
"""

from __future__ import annotations

_M = 2147483647


def uniform_int(draw: str, place: str, seed: int) -> str:
    """SQL: pseudo-random BIGINT in [0, 2**31 - 1) for (draw, place)."""
    u = f"((CAST({draw} AS BIGINT) * 48271 + CAST({place} AS BIGINT) * 69621 + {seed * 7919 + 12345}) % {_M})"
    v = f"(({u} * ({u} % 65521 + 1) + 1103515245) % {_M})"
    return f"(({v} * 16807 + {u}) % {_M})"


def hash_order(column: str) -> str:
    """SQL: 60-bit number from the text of ``column``; a fixed but arbitrary order."""
    return f"bigint(conv(substring(md5(string({column})), 1, 15), 16, 10))"
