"""Spans in texts: byte offsets to code points, joined strings and their digests."""

from __future__ import annotations

import hashlib

import numpy as np


def code_points(data: bytes, spans: list[tuple]) -> list[tuple]:
    """Spans (kind, start, end, ...) in bytes of UTF-8 to code points."""
    if not spans or data.isascii():
        return spans
    first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(first, out=at[1:])
    return [(kind, int(at[start]), int(at[end]), *rest) for kind, start, end, *rest in spans]


def joined(spans: list[tuple]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
