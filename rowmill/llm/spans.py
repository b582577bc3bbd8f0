"""Spans found in texts: kind, start and end in code points, end exclusive."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (x[1], order[x[0]], x[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
