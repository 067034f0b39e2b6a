"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become template tokens: numbers turn into a typed
placeholder, a number with a unit (``5 km``, ``5km``) into another, capitalised
words inside a sentence into a third; everything else is a lower-cased word.
Every window of ``WINDOW`` template tokens with enough literal words is hashed,
and the windows of the texts are hash-joined with those of the items.  A text's
hits on an item are grouped by alignment (its position minus the item's); an
alignment is consistent if each slot value of the item always stands for one and
the same value in the text.  A text is contaminated by an item if its consistent
alignments cover ``SHARE`` of the item's windows or more - whatever the numbers,
names and units it was re-parameterised with.

An item shorter than ``WINDOW`` tokens is one window of its own length.

Capitalised words that open a sentence are ordinary words in that view; in a
further one they are names too.  It has the same windows, as long as half of
their tokens are still words, and its alignments are consistent by themselves,
which sorts out opening words that are no names.

Windows poor in words and items under ``LEAST`` tokens have no placeholder view;
every item also has an exact view, all slot values as words and no such bounds,
so that a verbatim copy of any item is found.  Its share is taken of all of the
item's windows and its alignments are consistent in both views.  An item of one
word therefore matches every text with that word: items under ``LEAST`` tokens are
reported (``contaminated`` gives their ``size``), but ``decontaminated`` drops no text
for them.

Scale: the texts are read once.  If the benchmark's windows are few by count,
their sorted hashes go to the executors and only matching windows enter the
join; otherwise all windows do, shuffled by hash.  Hits are aggregated by
(text, item, alignment), which the item's length bounds.

Defined results: a null text counts as empty and is never contaminated; null
items are ignored; repeated items are one item each by id, repeated texts are
reported together (and all dropped); null ids are kept apart by their texts; empty
tables give no hits; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.store import batched, col, content, free, settle, small, table

WINDOW = 8
LEAST = 4
LITERAL = 0.6  # of a window's tokens must be words
LITERAL_OPENING = 0.5  # and so many still where opening words count as names
SHARE = 0.3
FEW_WINDOWS = 2_000_000  # 8 bytes each: the most hashes that go to every executor

UNITS = (b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
         b"mg g kg t oz lb lbs pound pounds gram grams kilogram kilograms ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
         b"s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         b"percent usd eur gbp dollar dollars euro euros cent cents degree degrees celsius fahrenheit w kw mw v volt volts a amp amps "
         b"hz khz mhz ghz kb mb gb tb mph kmh kph").split()  # fmt: skip
_UNIT_HASHES = np.sort(W.words(np.frombuffer(b" ".join(UNITS), dtype=np.uint8))[2])
NUMBER, QUANTITY, NAME = (np.uint64(x) for x in W._splitmix(3, 505))
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[33, 46, 58, 63, 10, 13]] = 1


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), dtype=bool)


def _folded(raw: np.ndarray) -> np.ndarray:
    """Accented Latin-1 capitals lower-cased (ASCII ones are when words are hashed)."""
    at = np.flatnonzero(raw[:-1] == 0xC3) + 1
    at = at[(raw[at] >= 0x80) & (raw[at] <= 0x9E) & (raw[at] != 0x97)]
    if not len(at):
        return raw
    out = raw.copy()
    out[at] += 32
    return out


PLACEHOLDERS, EXACT, OPENING = 0, 1, 2  # kinds of windows
_SALT = (np.uint64(0), *W._splitmix(2, 506))


def canonical(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of a text: token hashes, whether each is a slot, slot values (0 elsewhere), whether it is a name, whether it is a capitalised word that opens a sentence."""
    start, end, value = W.words(_folded(raw))
    if not len(start):
        return value, np.zeros(0, dtype=bool), value, np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    digits, stops = np.zeros(len(raw) + 1, dtype=np.int64), np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_DIGIT[raw], out=digits[1:])
    np.cumsum(_STOP[raw], out=stops[1:])
    size, many = end - start, digits[end] - digits[start]
    number = many == size
    before = np.concatenate([[0], end[:-1]])
    opens = stops[start] - stops[before] > 0
    opens[0] = True
    b0 = raw[start]
    b1 = raw[np.minimum(start + 1, len(raw) - 1)]
    title = (b0 >= 65) & (b0 <= 90) & (size > 1) & ((b1 >= 97) & (b1 <= 122) | (b1 >= 128))
    title |= (b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E) & (size > 2)
    name, opening = title & ~opens & ~number, title & opens & ~number
    # digits, then letters: a number with its unit attached
    lead = _DIGIT[b0] == 1
    quantity = lead & ~number
    for i in np.flatnonzero(quantity):
        k = int(many[i])
        tail = raw[start[i] + k : end[i]]
        h = W.words(tail)[2]
        quantity[i] = digits[start[i] + k] - digits[start[i]] == k and len(h) == 1 and bool(_in(h, _UNIT_HASHES)[0])
    # 1.5 and 1,000 are one number each; a unit after a number belongs to it
    follows = np.zeros(len(start), dtype=bool)
    gap = start[1:] - end[:-1]
    mark = raw[end[:-1]]
    follows[1:] = number[1:] & number[:-1] & (gap == 1) & ((mark == 46) | (mark == 44))
    unit = np.zeros(len(start), dtype=bool)
    unit[1:] = _in(value[1:], _UNIT_HASHES) & number[:-1] & (gap == 1) & (mark == 32)
    slot = number | name | quantity
    token = np.where(number, NUMBER, np.where(quantity, QUANTITY, np.where(name, NAME, value)))
    held = np.where(slot, value, np.uint64(0))
    part = follows | unit
    if part.any():
        head = np.flatnonzero(~part)
        group = np.cumsum(~part) - 1
        for i in np.flatnonzero(part):
            held[head[group[i]]] = W.mix(held[head[group[i], None]] * np.uint64(31) + value[i])[0]
            if unit[i]:
                token[head[group[i]]] = QUANTITY
        token, slot, held, name, opening = token[head], slot[head], held[head], name[head], opening[head]
    return token, slot, held, name, opening


def windows(token: np.ndarray, slot: np.ndarray, size: int, least: float = LITERAL) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows with enough words."""
    h = W.grams(token, size)
    if not len(h):
        return np.zeros(0, dtype=np.int64), h
    h = W.mix(h + np.uint64(size))
    words = np.concatenate([[0], np.cumsum(~slot)])
    at = np.flatnonzero(words[size:] - words[:-size] >= least * size)
    return at, h[at]


def views(raw: np.ndarray, sizes: list[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """A text's windows (kind, starts, hashes, slot flags, slot values, size); sizes None takes the item's own.

    Windows with names come twice, with placeholders and with the names as
    words, so that a change of case doesn't hide a verbatim copy.  All windows
    come once more in the exact kind, with every slot value as a word, and where there
    are capitals in the opening kind, with opening words as names.
    """
    token, slot, held, name, opening = canonical(raw)
    if sizes is None:
        sizes = [min(WINDOW, len(token))] if len(token) else []
    plain = slot & ~name
    for size in sizes:
        h = W.grams(np.where(slot, held, token), size)
        yield EXACT, np.arange(len(h)), W.mix(h + np.uint64(size)) ^ _SALT[EXACT], plain, held, size
        if size < LEAST:
            continue
        yield PLACEHOLDERS, *windows(token, slot, size), slot, held, size
        if name.any():
            at, h = windows(np.where(name, held, token), plain, size)
            names = np.concatenate([[0], np.cumsum(name)])
            some = names[at + size] > names[at]
            yield PLACEHOLDERS, at[some], h[some], plain, held, size
        if name.any() or opening.any():
            wide = slot | opening
            at, h = windows(np.where(opening, NAME, token), wide, size, LITERAL_OPENING)
            words = np.concatenate([[0], np.cumsum(~slot)])
            some = words[at + size] - words[at] >= LITERAL * size
            yield OPENING, at[some], h[some] ^ _SALT[OPENING], wide, np.where(opening, token, held), size


_HIT = "kind int, hash bigint, pos bigint, slots array<bigint>"


def _emit(keys: list[pa.Array], names: list[str], hits: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of windows: hits are (row, kind, starts, hashes, slot flags, slot values, size)."""
    row, kinds, pos, hashes, slots = [], [], [], [], []
    for r, kind, at, h, slot, held, size in hits:
        for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            row.append(r)
            kinds.append(kind)
            pos.append(p)
            hashes.append(x)
            slots.append(held[p : p + size][slot[p : p + size]].view(np.int64).tolist())
    index = pa.array(row, type=pa.int64())
    yield pa.RecordBatch.from_arrays([*(k.take(index) for k in keys), pa.array(kinds, type=pa.int32()), pa.array(hashes, type=pa.int64()), pa.array(pos, type=pa.int64()), pa.array(slots, type=pa.list_(pa.int64()))], names=[*names, "kind", "hash", "pos", "slots"])


def item_windows(benchmark: DataFrame, text: str = "text", id: str = "item_id") -> DataFrame:
    """Windows of the items: item, size, kind, hash, pos, slots and the item's numbers of windows with words enough (total) and of all (whole)."""
    kind = benchmark.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, sizes, totals, wholes = [], [0] * b.num_rows, [0] * b.num_rows, [0] * b.num_rows
            for r in range(b.num_rows):
                starts: list[set[int]] = [set(), set(), set()]
                for of, at, h, slot, held, size in views(np.frombuffer((b.column(1)[r].as_py() or "").encode(), dtype=np.uint8), None):
                    sizes[r] = size
                    starts[of].update(at.tolist())
                    hits.append((r, of, at, h, slot, held, size))
                totals[r], wholes[r] = len(starts[PLACEHOLDERS]), len(starts[EXACT])
            yield from _emit([b.column(0), pa.array(sizes, type=pa.int32()), pa.array(totals, type=pa.int64()), pa.array(wholes, type=pa.int64())], ["item", "size", "total", "whole"], hits)

    return benchmark.where(F.col(text).isNotNull()).select(id, text).distinct().mapInArrow(run, f"item {kind}, size int, total bigint, whole bigint, {_HIT}")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", share: float = SHARE) -> DataFrame:
    """Rows (``_id``, ``_a``, ``_b``, item, size, windows, matched, share): the texts, by id and text hash, and the items in them; ``size`` is that of the item's windows in tokens."""
    kind = docs.schema[id].dataType.simpleString()
    items = settle(item_windows(benchmark, "text", item), "items")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())
    few = items.count() <= FEW_WINDOWS
    known = np.sort(items.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64)) if few else None  # 8 bytes a window
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        likely = np.zeros(1 << 22, dtype=bool)  # by a hash's low bits, before it is looked for
        if hashes is not None:
            likely[hashes & np.uint64((1 << 22) - 1)] = True
        for b in batches:
            raw, offsets = W.column_bytes(b.column(3))
            hits, held_back = [], 0
            for r in range(b.num_rows):
                for of, at, h, slot, held, size in views(raw[offsets[r] : offsets[r + 1]], sizes):
                    if hashes is not None and len(at):
                        ok = likely[h & np.uint64((1 << 22) - 1)]
                        at, h = at[ok], h[ok]
                        ok = _in(h, hashes)
                        at, h = at[ok], h[ok]
                    if len(at):
                        hits.append((r, of, at, h, slot, held, size))
                        held_back += len(at)
                if held_back > 50_000:
                    yield from _emit(b.columns[:3], ["_id", "_a", "_b"], hits)
                    hits, held_back = [], 0
            yield from _emit(b.columns[:3], ["_id", "_a", "_b"], hits)

    a, b = content(col(text))
    keyed = batched(docs).select(col(id).alias("_id"), a.alias("_a"), b.alias("_b"), col(text))
    hits = keyed.mapInArrow(run, f"_id {kind}, _a bigint, _b bigint, {_HIT}")
    own = items.select("item", F.col("size").alias("_size"), "total", "whole", F.col("kind").alias("_kind"), F.col("hash").alias("_hash"), F.col("pos").alias("_pos"), F.col("slots").alias("_slots"))
    met = hits.join(small(own) if few else own, (hits["hash"] == own["_hash"]) & (hits["kind"] == own["_kind"])).where(F.size("slots") == F.size("_slots"))
    pairs = F.arrays_zip(F.col("_slots").alias("x"), F.col("slots").alias("y"))
    of = ["_id", "_a", "_b", "item", "_size", "total", "whole"]
    by = lambda kind, x: F.when(F.col("kind") == kind, x)
    distinct = lambda x: F.array_distinct(F.flatten(x))
    lines = met.groupBy(*of, (F.col("pos") - F.col("_pos")).alias("_line")).agg(
        F.collect_set(by(PLACEHOLDERS, F.col("_pos"))).alias("_at"), F.collect_set(by(EXACT, F.col("_pos"))).alias("_exact"), F.collect_set(by(OPENING, F.col("_pos"))).alias("_open"),
        distinct(F.collect_set(by(PLACEHOLDERS, pairs))).alias("_pairs"), distinct(F.collect_set(F.when(F.col("kind") != OPENING, pairs))).alias("_every"), distinct(F.collect_set(by(OPENING, pairs))).alias("_names"),
    )
    steady = lambda x: F.size(x) == F.size(F.array_distinct(F.transform(x, lambda p: p["x"])))
    held = lambda at, ok: F.when(ok, F.col(at)).otherwise(F.array().cast("array<bigint>"))
    count = lambda at: F.size(distinct(F.collect_list(at))).cast("long")
    found = lines.groupBy(*of).agg(count(F.concat(held("_at", steady("_pairs")), held("_open", steady("_names")))).alias("_some"), count(held("_exact", steady("_every"))).alias("_all"))
    best = F.greatest(*[F.struct(F.coalesce(F.try_divide(F.col(m), F.col(n)), F.lit(0.0)).alias("share"), F.col(n).alias("windows"), F.col(m).alias("matched")) for m, n in (("_some", "total"), ("_all", "whole"))])
    return found.select(*of[:5], best.alias("_best")).select(*of[:4], F.col("_size").alias("size"), F.col("_best.windows").alias("windows"), F.col("_best.matched").alias("matched"), F.col("_best.share").alias("share")).where(F.col("share") >= share)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` without the texts contaminated by an item of ``LEAST`` tokens or more."""
    names = free(docs, "_gone", "_a", "_b")
    gone = small(settle(contaminated(docs, benchmark, text, id).where(F.col("size") >= LEAST).select("_id", "_a", "_b").distinct().toDF(*names), "contaminated"))
    a, b = content(col(text))
    return docs.join(gone, col(id).eqNullSafe(F.col(names[0])) & (a == F.col(names[1])) & (b == F.col(names[2])), "left_anti")


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("_id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("windows").alias("windows"), F.max("matched").alias("matched"), F.round(F.max("share"), 6).alias("share"))


QUERIES = {"op5_template_decontamination": op5_template_decontamination}
SQL: dict[str, str] = {}
