"""Periodic runs of words, and their collapse.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal), at least ``max(MIN_WORDS, 2 * q)`` words long, that no neighbouring
word extends with period q.  Words are what white space (``\\x20``, ``\\x09`` to
``\\x0D``) parts.  Collapsing keeps the first q words of each run: a word goes if
any run holds it after that run's first q words.

A run of period p covers two neighbouring points of the grid 0, p, 2p, ..., and
all grids together have n ln n points (the harmonic sum).  The texts of a block
are laid end to end, a word of its own after each, and handled in rounds of
``PAIRS`` (period, point) pairs:

1. A pair is looked at further only if three words beside it equal the three
   words p later: every run goes on for at least six words beyond its period,
   hence for three to one side of the point.
2. Of the pairs inside one stretch only the first goes on: a pair whose p words
   before it equal the p words at it has a neighbour in the same stretch.
3. For all others the longest common extensions to both sides are found at
   once by binary search over prefix hashes (two moduli below 2**31).
4. A stretch of ``2 * p`` words or more is verified word by word; if hashes lied,
   its ends are found by comparing words.  Of equal stretches the smallest
   period stays: it divides the others.

Scale: a text is one row of an Arrow map, nothing is shuffled, and lost tasks
are simply read again.  Memory is a few dozen bytes for each word of a block
(``BLOCK_WORDS`` words, or one longer text) and for each pair of a round.

Defined results: a null text stays null and counts as no words; a text without
words has no runs and collapses to the empty text; rows are judged one by one, so
null and repeated ids, repeated rows and empty tables need no special care; extra
columns are never read; an id may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm.store import batched, col, table

MIN_WORDS = 12
BLOCK_WORDS = 1 << 16  # words handled together
PAIRS = 1 << 18  # (period, point) pairs handled together
MODULI = (2**31 - 1, 2**31 - 19)
BASES = (1_000_000_007, 998_244_353)
NEAR = 3  # words that must agree beside a grid point


class Hashes:
    """Prefix hashes of a sequence of word numbers."""

    def __init__(self, w: np.ndarray):
        self.parts = []
        for m, base in zip(MODULI, BASES, strict=True):
            m = np.uint64(m)
            power = np.ones(len(w) + 1, dtype=np.uint64)
            done, step = 1, base % int(m)
            while done < len(power):  # powers by doubling
                k = min(done, len(power) - done)
                power[done : done + k] = power[:k] * np.uint64(step) % m
                done, step = done + k, step * step % int(m)
            value = (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % m + np.uint64(1)
            total = np.zeros(len(w) + 1, dtype=np.uint64)
            np.cumsum(value * power[:-1] % m, out=total[1:])  # below 2**63 for 2**32 words
            self.parts.append((m, power, total % m))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a equal those from b, a <= b."""
        ok = np.ones(len(a), dtype=bool)
        for m, power, total in self.parts:
            one, two = total[a + size] + m - total[a], total[b + size] + m - total[b]
            ok &= one % m * power[b - a] % m == two % m
        return ok


def _extend(h: Hashes, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For all pairs at once: the greatest size up to ``most`` with which words from i on (or, ``back``, up to i) equal those at j."""
    lo, hi = np.zeros(len(i), dtype=np.int64), most.astype(np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_] + 1) >> 1
        shift = mid if back else 0
        ok = h.equal(i[open_] - shift, j[open_] - shift, mid)
        lo[open_[ok]] = mid[ok]
        hi[open_[~ok]] = mid[~ok] - 1


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """The first place at which two arrays differ, or their length."""
    at = np.flatnonzero(x != y)
    return int(at[0]) if len(at) else len(x)


def runs(w: np.ndarray, longest: int | None = None, pairs: int = PAIRS, hashes: type[Hashes] = Hashes) -> np.ndarray:
    """Runs (start, end, period) of a sequence of word numbers, by start and then period; ``longest``: the most words of one text in it."""
    n = len(w)
    top = (longest or n) // 2
    if n < MIN_WORDS or top < 1:
        return np.zeros((0, 3), dtype=np.int64)
    h, w = hashes(w), w.astype(np.int64)
    # three words from a place as one number: wrong agreements only cost time
    gram = np.full(n, -1, dtype=np.int64)
    gram[: n - 2] = (w[:-2] * 0x2545F491 + w[1:-1]) * 0x2545F491 + w[2:]
    points = (n - 1) // np.arange(1, top + 1)  # grid points i with i + p < n: 0, p, ...
    ends = np.cumsum(points)
    seen: dict[tuple[int, int], int] = {}
    for lo in range(0, int(ends[-1]), pairs):
        flat = np.arange(lo, min(lo + pairs, int(ends[-1])))
        first, last = np.searchsorted(ends, [flat[0], flat[-1]], side="right")
        p = np.repeat(np.arange(first + 1, last + 2), np.diff(np.concatenate([[lo], np.minimum(ends[first : last + 1], flat[-1] + 1)])))
        i = (flat - (ends[p - 1] - points[p - 1])) * p
        ahead = gram[i] == gram[i + p]
        ahead |= (i >= NEAR) & (gram[i - NEAR] == gram[i + p - NEAR])
        i, p = i[ahead], p[ahead]
        inner = np.flatnonzero(i >= p)
        again = np.zeros(len(i), dtype=bool)
        again[inner] = h.equal(i[inner] - p[inner], i[inner], p[inner])
        i, p = i[~again], p[~again]
        if not len(i):
            continue
        on, back = _extend(h, i, i + p, n - i - p, False), _extend(h, i, i + p, i, True)
        long = on + back + p >= np.maximum(2 * p, MIN_WORDS)
        for a, q, f, b in zip(i[long].tolist(), p[long].tolist(), on[long].tolist(), back[long].tolist(), strict=True):
            s, e = a - b, a + q + f
            if q % seen.get((s, e), q + 1) == 0:
                continue  # a multiple of a verified period of the same stretch
            true = (w[s : e - q] == w[s + q : e]).all() and (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n or w[e] != w[e - q])
            if not true:
                e = a + q + _differ(w[a : n - q], w[a + q :])
                s = a - _differ(w[:a][::-1], w[q : a + q][::-1])
                if e - s < max(2 * q, MIN_WORDS):
                    continue
            seen[s, e] = min(q, seen.get((s, e), q))
    return np.array(sorted((s, e, q) for (s, e), q in seen.items()), dtype=np.int64).reshape(-1, 3)


def collapse(texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Per text: its number of words, its runs (start, length, period) by start and then period, and the kept words joined by spaces."""
    held = [(t or b"").split() for t in texts]  # of bytes: at exactly the six separators
    numbers: dict[bytes, int] = {}
    counts = np.array([len(x) for x in held], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(counts + 1)])
    w = np.empty(int(begins[-1]), dtype=np.int64)
    for at, x in zip(begins.tolist(), held, strict=False):
        w[at : at + len(x)] = [numbers.setdefault(y, len(numbers)) for y in x]
    w[begins[1:] - 1] = len(numbers) + np.arange(len(held))  # equal to nothing, so no run leaves its text
    found = runs(w, int(counts.max(initial=0)))
    gone = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 1], -1)
    gone = np.cumsum(gone)[:-1] > 0
    of = np.searchsorted(begins, found[:, 0], side="right") - 1
    mine: list[list[tuple[int, int, int]]] = [[] for _ in held]
    for r, (s, e, q) in zip(of.tolist(), found.tolist(), strict=True):
        mine[r].append((s - int(begins[r]), e - s, q))
    out = []
    for r, x in enumerate(held):
        at = int(begins[r])
        kept = [x[k] for k in np.flatnonzero(~gone[at : at + len(x)])] if mine[r] else x
        out.append((len(x), mine[r], b" ".join(kept)))
    return out


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse_runs(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``runs`` (start and length in words, period) and ``collapsed``, the text of its kept words."""
    kind = docs.schema[id].dataType.simpleString()
    arrow = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            done = 0
            while done < b.num_rows:  # a word and its separator take two bytes at least
                more = max(1, int(np.searchsorted(np.cumsum(sizes[done:]), 6 * BLOCK_WORDS, side="right")))
                part = texts.slice(done, more).to_pylist()
                rows = collapse(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(done, more), pa.array([n for n, _, _ in rows], type=pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in rows], type=arrow),
                        pa.array([None if t is None else k.decode("utf-8", "replace") for t, (_, _, k) in zip(part, rows, strict=True)], type=pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )
                done += more

    found = batched(docs).select(col(id).alias("id"), col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, runs {RUNS}, collapsed string")
    return found.select(F.col("id").alias(id), "n_words", "runs", "collapsed")


def planted(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id`` and ``text`` of the rows, every tenth text (by the checksum of its id) with a periodic tail; a null id or text stays as it is."""
    rows = docs.select(col(id).alias("k"), col(text).alias("t"), F.crc32(col(id).cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    rows = rows.withColumn("x", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(size(x) > 0, g % size(x), null)")).withColumn("p", F.expr("1 + (size(x) - a) div (3 + g % 8)"))
    told = F.expr("array_join(transform(x, (w, i) -> if(i >= a, x[int(a + (i - a) % p)], w)), ' ')")
    return rows.select(F.col("k").alias(id), F.when(F.col("a").isNotNull(), told).otherwise(F.col("t")).alias(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
