"""Word and shingle hashing over UTF-8 bytes, in numpy.

A word is a maximal run of bytes other than ``\\x00-\\x2F``, ``\\x3A-\\x60`` and
``\\x7B-\\x7F`` once A-Z are lower-cased: ASCII digits and letters, and every
non-ASCII character.  Hashes depend on the bytes alone, so they agree between
processes, machines and runs.

Texts are cut into pieces of about a megabyte (at a separator), so scratch
memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at once
U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def mix(z: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value (a bijection)."""
    z = (z ^ (z >> U(32))) * U(0xD6E8FEB86659FD93)
    z = (z ^ (z >> U(29))) * U(0xA0761D6478BD642F)
    return z ^ (z >> U(32))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True
_VALUE = _splitmix(256, 11)[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=U)
    out[0] = 1
    return np.cumprod(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE), _powers(_UNBASE)
    return _TABLES["up"], _TABLES["down"]


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _tables()
    flag = np.zeros(len(raw) + 2, dtype=np.int8)
    flag[1:-1] = IS_WORD[raw]
    turn = np.flatnonzero(flag[1:] != flag[:-1])
    start, end = turn[0::2], turn[1::2]
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte offsets) and 64-bit hashes of the words in uint8 ``raw``.

    A word longer than a piece is hashed in pieces and combined, so that equal
    words always get equal hashes.
    """
    if len(raw) <= PIECE:
        return _piece(raw)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(raw):
        to = min(len(raw), at + PIECE)
        if to < len(raw):
            gaps = np.flatnonzero(~IS_WORD[raw[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word fills the piece
                run = at + PIECE
                while run < len(raw) and IS_WORD[raw[run]]:
                    step = raw[run : run + PIECE]
                    stop = np.flatnonzero(~IS_WORD[step])
                    run += int(stop[0]) if len(stop) else len(step)
                    if len(stop):
                        break
                acc = np.zeros(1, dtype=U)
                for k in range(at, run, PIECE):
                    acc = mix(acc * U(31) + _piece(raw[k : min(run, k + PIECE)])[2])
                starts.append(np.array([at]))
                ends.append(np.array([run]))
                hashes.append(acc)
                at = run
                continue
        s, e, h = _piece(raw[at:to])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (empty if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= U(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mix(out)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a text of 1 to k-1 words is one shingle."""
    if 0 < len(hashes) < k:
        return grams(hashes, len(hashes)) ^ U(len(hashes))
    return np.unique(grams(hashes, k))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spaced(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i to j-1 with a space after each, so that nothing runs on from row to row, and where each begins (and the end)."""
    lo, hi = int(offsets[i]), int(offsets[j])
    sizes = np.diff(offsets[i : j + 1])
    out = np.full(hi - lo + (j - i), 32, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(sizes) + np.arange(j - i)] = False
    out[keep] = raw[lo:hi]
    return out, np.concatenate([[0], np.cumsum(sizes + 1)])


def block_words(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i to j-1: starts, ends (offsets into ``raw``), hashes and n+1 row boundaries."""
    lo, hi = int(offsets[i]), int(offsets[j])
    if j - i == 1:
        s, e, h = words(raw[lo:hi])
        return s + lo, e + lo, h, np.array([0, len(h)])
    apart, begins = spaced(raw, offsets, i, j)
    s, e, h = words(apart)
    bounds = np.searchsorted(s, begins)
    row = np.repeat(np.arange(j - i), np.diff(bounds))
    return s - row + lo, e - row + lo, h, bounds
