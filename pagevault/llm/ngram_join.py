"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their distinct five-word
shingles is at least 0.8.

1. Each text is reduced to a digest of its shingle set, its number of shingles
   and MinHash values (their low 16 bits).  Texts with equal sets form a class;
   only classes go on, so copies never meet each other.
2. Classes that share a band of values make a bucket.  Each member is compared
   with the bucket's smallest class, its hub.  MinHash values are compared 16 at
   a time; after each step a pair is dropped if, under a uniform prior, the
   posterior probability that its similarity reaches the threshold falls below
   ``TOLERANCE``.  Pairs that survive connect their classes (``components``).
3. In a bucket whose members are still not all connected, members of different
   components are compared with each other in the same way: the bucket is dealt
   into blocks of bounded size, and each pair of blocks is one group, which
   returns a forest of the surviving pairs, not the pairs.  Both forests together
   connect every two classes that share a band and survive.
4. The components of what survived - pairs that are probably similar, not merely
   in one bucket - are dealt into blocks of bounded weight; each pair of blocks is
   one group in which all pairs are compared as above and what is left is
   verified exactly on the shingle sets.  A group returns a count of links and a
   local root per class.
5. Counts are summed and local roots connected to groups.

No pair at similarity 0.8 or more is given up but by chance: a pair at exactly
0.8 shares none of the 24 bands of 4 values with probability 3e-6, and is pruned
with probability under 1e-6.  There is no cap on buckets, partners or blocks.

Scale: texts are read twice and only candidates' texts are shuffled, once per
block they meet; band rows are small, pre-aggregated and joined (skew-splittable).
Since only surviving pairs connect, components stay as small as groups of near
copies are, however many bands collide by chance.  A component of n classes costs
n**2 / 2 comparisons of a few bytes, spread over its block pairs; that is the
price of exact link counts.  A class with many rows, or a hub with many members,
would be one hot key: keys with more than 1 / ``HOT`` of all rows, fewer than
``HOT`` by number, are broadcast and salted ``SALTS`` ways before the join.

Defined results: a null text counts as empty; texts without words have one,
empty, shingle set, hence one class and no links; a text of one to four words is
one shingle; repeated rows and repeated ids are members of their texts' classes;
null ids stay null in the result and never name a class unless all its ids are
null; an empty table gives an empty result; extra columns are never read (and
``one_of_each`` passes them through, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.components import components
from pagevault.llm.store import batched, col, discard, free, settle, small, table

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-7
BLOCK_WEIGHT = 600_000  # shingles (and 200 a class) in a block
BLOCK_ROWS = 4096  # members of a bucket in a block
HOT = 10_000  # a key with more than this part of all rows is hot; there are fewer than so many
SALTS = 32  # ways a hot key is split
U32 = np.uint32

_seeds = W._splitmix(2 * HASHES, 77)
MULTIPLY, ADD = (_seeds[:HASHES] >> np.uint64(32)).astype(U32) | U32(1), (_seeds[HASHES:] >> np.uint64(32)).astype(U32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (texts, HASHES); all ones for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, dtype=U32)
    full = sizes > 0
    if full.any():
        flat = np.concatenate(sets)
        flat = (flat ^ (flat >> np.uint64(32))).astype(U32)
        at = (np.cumsum(sizes) - sizes)[full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(flat * MULTIPLY[k] + ADD[k], at)
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    key = np.zeros((len(values), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return key.view(np.int64)


def short(values: np.ndarray) -> np.ndarray:
    """The low 16 bits of MinHash values: equal values stay equal, others are so with probability 2**-16."""
    return values.astype(np.uint16)


def signatures(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = WORDS) -> DataFrame:
    """Per row: ``id``, hash of the text t, digest (a, b), number of shingles n, band keys and short MinHash values (both empty for a wordless text)."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.column_bytes(batch.column(1))
            for i, j in W.blocks(offsets):
                _, _, h, at = W.block_words(raw, offsets, i, j)
                sets = [W.shingles(h[at[r] : at[r + 1]], k) for r in range(j - i)]
                values, sizes = minhash(sets), np.array([len(s) for s in sets])
                keys, held = bands(values), short(values)
                a, b = zip(*(digest(s) for s in sets), strict=True)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[sizes > 0].reshape(-1)))
                marks = pa.array([held[r].tobytes() if sizes[r] else b"" for r in range(j - i)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.array(sizes, type=pa.int64()), lists, marks], names=["id", "t", "a", "b", "n", "bands", "marks"])

    return batched(docs).select(col(id), col(text), F.xxhash64(col(text)).alias("t")).mapInArrow(run, f"id {kind}, t bigint, a bigint, b bigint, n bigint, bands array<bigint>, marks binary")


def by_key(left: DataFrame, right: DataFrame, on: list[str], rows: str, spread: Column) -> DataFrame:
    """An equi-join with a settled table, one row a key, that counts the left table's ``rows`` of each key.

    Keys with more than 1 / ``HOT`` of all rows are split ``SALTS`` ways: left rows by
    ``spread``, right ones are copied.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) > total / HOT
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    known = left.join(F.broadcast(right.where(hot).select(*on, F.lit(True).alias("_hot"))), on, "left")
    salted = known.withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    return salted.join(dealt, [*on, "_salt"]).drop("_salt")


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After 16, 32, ... compared values: the fewest matches with which a pair is kept.

    With a uniform prior and m of n matches the posterior is Beta(m + 1, n - m +
    1), and its mass above the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def linked(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], values: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left index < right index where both come from one block) of texts at the threshold or more.

    ``left`` and ``right`` index ``sets``; if they are the same array each pair is met once.
    """
    same, need = left is right, needed(threshold)
    first: list[np.ndarray] = []
    second: list[np.ndarray] = []
    x, y = values[left], values[right]
    for lo in range(0, len(left), 256):
        part = x[lo : lo + 256]
        match = np.zeros((len(part), len(right)), dtype=np.uint8)
        for k in range(STEP):
            match += part[:, k, None] == y[None, :, k]
        i, j = np.nonzero(match >= need[0])
        m = match[i, j].astype(np.int64)
        if same:
            keep = i + lo < j
            i, j, m = i[keep], j[keep], m[keep]
        for step in range(1, HASHES // STEP):
            cut = slice(step * STEP, (step + 1) * STEP)
            for c in range(0, len(i), 1 << 16):
                m[c : c + (1 << 16)] += (part[i[c : c + (1 << 16)], cut] == y[j[c : c + (1 << 16)], cut]).sum(axis=1)
            keep = m >= need[step]
            i, j, m = i[keep], j[keep], m[keep]
        first.append(left[i + lo])
        second.append(right[j])
    i, j = np.concatenate(first), np.concatenate(second)
    ok = _common(i, j, sets) >= threshold / (1 + threshold) * np.array([len(s) for s in sets])[np.stack([i, j])].sum(axis=0) - 1e-9 if len(i) else np.zeros(0, dtype=bool)
    return i[ok], j[ok]


def _common(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each pair, exactly."""
    used = np.unique(np.concatenate([i, j]))
    if len(i) <= 8 * len(used):
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)])
    place = np.zeros(len(sets), dtype=np.int64)
    place[used] = np.arange(len(used))
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    more = times[column] > 1  # a shingle of one text alone is in no intersection
    row, column = row[more], np.unique(column[more], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, 4096):
        cut = slice(*np.searchsorted(column, [lo, lo + 4096]))
        held = np.zeros((len(used), min(4096, last - lo)), dtype=np.float32)
        held[row[cut], column[cut] - lo] = 1
        total += held @ held.T
    return np.rint(total[place[i], place[j]]).astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of n vertices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _group(pair: tuple[int, int], rows: pa.Table, k: int, threshold: float) -> pa.Table:
    """Links and local roots among the classes of one pair of blocks."""
    raw, offsets = W.column_bytes(rows["text"])
    want = list(zip(rows["a"].to_pylist(), rows["b"].to_pylist(), rows["block"].to_pylist(), strict=True))
    sets, names, block = [], [], []
    seen = set()
    for r, (a, b, of) in enumerate(want):
        if (a, b) in seen:
            continue
        s = W.shingles(W.words(raw[offsets[r] : offsets[r + 1]])[2], k)
        if digest(s) == (a, b):  # else another text under a repeated id
            seen.add((a, b))
            sets.append(s)
            names.append((a, b))
            block.append(of)
    order = sorted(range(len(names)), key=names.__getitem__)
    sets, names, block = [sets[o] for o in order], [names[o] for o in order], np.array([block[o] for o in order], dtype=np.int64)
    values = minhash(sets)
    left = np.flatnonzero(block == pair[0])
    right = left if pair[0] == pair[1] else np.flatnonzero(block == pair[1])
    i, j = linked(left, right, sets, values, threshold) if len(left) and len(right) else (np.zeros(0, dtype=np.int64),) * 2
    links, root = np.bincount(np.concatenate([i, j]), minlength=len(names)), _roots(len(names), i, j)
    some = np.flatnonzero(links)
    of = lambda index, side: pa.array([names[x][side] for x in index], type=pa.int64())
    return pa.table({"a": of(some, 0), "b": of(some, 1), "links": pa.array(links[some], type=pa.int64()), "root_a": of(root[some], 0), "root_b": of(root[some], 1)})


def survives(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each pair of rows of short MinHash values survives the incremental comparison."""
    need, left = needed(threshold), np.arange(len(x))
    m = np.zeros(len(x), dtype=np.int64)
    for step in range(HASHES // STEP):
        cut = slice(step * STEP, (step + 1) * STEP)
        m += (x[left, cut] == y[left, cut]).sum(axis=1)
        keep = m >= need[step]
        left, m = left[keep], m[keep]
    out = np.zeros(len(x), dtype=bool)
    out[left] = True
    return out


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), HASHES)


_EDGE = "u struct<a:bigint,b:bigint>, v struct<a:bigint,b:bigint>"


def _forest(rows: pa.Table, i_block: int, j_block: int, threshold: float) -> pa.Table:
    """A forest of the surviving pairs among members of different components, of one pair of a bucket's blocks."""
    values, block = _values(rows["marks"]), rows["block"].to_numpy()
    names = list(zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True))
    part = np.unique(np.array([f"{x['a']}:{x['b']}" for x in rows["root"].to_pylist()]), return_inverse=True)[1]
    left = np.flatnonzero(block == i_block)
    right = left if i_block == j_block else np.flatnonzero(block == j_block)
    root = np.arange(part.max() + 1)  # of components, so that one surviving pair joins two of them
    edges = []
    for x in left:
        other = right[root[part[right]] != root[part[x]]]
        if not len(other):
            continue
        ok = other[survives(np.broadcast_to(values[x], (len(other), HASHES)), values[other], threshold)]
        for y in ok:
            a, b = root[part[x]], root[part[y]]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                edges.append((names[x], names[y]))
    name = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    side = lambda s: pa.array([{"a": e[s][0], "b": e[s][1]} for e in edges], type=name)
    return pa.table({"u": side(0), "v": side(1)})


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (u, v) that connect every two settled classes which share a band and survive the comparison."""
    held = classes.select(F.struct("a", "b").alias("v"), F.explode("bands").alias("key"))
    bucket = held.groupBy("key").agg(F.min("v").alias("u"), F.max("v").alias("other"), F.count(F.lit(1)).alias("rows")).where("u != other").select("key", "u", "rows")
    bucket = settle(bucket, "buckets")
    members = settle(by_key(held, bucket, ["key"], "rows", F.xxhash64("v")).select("key", "u", "v", "rows"), "members")
    stars = settle(members.where("u != v").select("u", "v").distinct(), "stars")
    marks = classes.select("a", "b", "marks")
    spokes = stars.join(marks, (F.col("v.a") == F.col("a")) & (F.col("v.b") == F.col("b"))).select("u", "v", F.col("marks").alias("y"))
    hubs = stars.groupBy("u").agg(F.count(F.lit(1)).alias("rows")).join(marks, (F.col("u.a") == F.col("a")) & (F.col("u.b") == F.col("b"))).select("u", F.col("marks").alias("x"), "rows")
    hubs = settle(hubs, "hubs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = survives(_values(batch.column(2)), _values(batch.column(3)), threshold) if batch.num_rows else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))

    near = settle(by_key(spokes, hubs, ["u"], "rows", F.xxhash64("v")).select("u", "v", "x", "y").mapInArrow(compare, _EDGE), "near")
    of = settle(components(near, "connected").select(F.col("u").alias("v"), "root"), "connected")
    # members that no hub took are components of their own
    named = members.join(of, "v", "left").select("key", "rows", "v", F.coalesce("root", "v").alias("root"))
    open_ = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("rows").alias("rows")).where("lo != hi AND rows > 2").select("key", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), "rows")
    open_ = settle(open_, "open")
    left = by_key(named.drop("rows"), open_, ["key"], "rows", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    left = left.join(marks, (F.col("v.a") == F.col("a")) & (F.col("v.b") == F.col("b")))
    met = left.select("key", "a", "b", "root", "marks", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    met = met.select("key", "a", "b", "root", "marks", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _forest(rows, key[1].as_py(), key[2].as_py(), threshold)

    more = settle(met.groupBy("key", "i", "j").applyInArrow(run, _EDGE), "more")
    out = settle(near.unionByName(more).distinct(), "candidates")
    discard(bucket, members, stars, hubs, near, of, open_, more)
    return out


def similar(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, bool]:
    """Two settled tables: rows (id, a, b), one for each row of ``docs``; and classes (a, b, class_id, class_size, n_links, group_id, root); and whether any id is null or repeated.

    ``class_id`` is the smallest id of the class, ``group_id`` that of the
    connected group, ``n_links`` the number of other classes it is linked to.
    """
    signed = settle(signatures(docs, text, id, k), "signed")
    rows = settle(signed.select("id", "a", "b"), "rows")
    odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").limit(1).count() > 0
    smallest = F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("rep")  # of the smallest id, null only if all are
    classes = settle(signed.groupBy("a", "b").agg(smallest, F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "classes")
    edges = candidates(classes, threshold)
    of = components(edges, "candidates").select(F.col("u.a").alias("a"), F.col("u.b").alias("b"), "root")
    met = settle(classes.select("a", "b", "class_id", F.col("rep.t").alias("t"), "n").join(of, ["a", "b"]), "candidates")
    weight = F.col("n") + 200
    sizes = met.groupBy("root").agg(F.ceil(F.sum(weight) / BLOCK_WEIGHT).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows"))
    dealt = by_key(met, settle(sizes, "sizes"), ["root"], "rows", F.xxhash64("a", "b")).select("a", "b", "class_id", "t", "root", "blocks", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int").alias("block"))
    dealt = settle(dealt, "dealt")
    texts = docs.select(col(id).alias("_id"), col(text).alias("text")).join(small(dealt), F.col("_id").eqNullSafe(F.col("class_id")) & (F.xxhash64("text") == F.col("t")))
    if odd:
        texts = texts.dropDuplicates(["root", "a", "b"])
    pairs = texts.select("root", "a", "b", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
    pairs = pairs.select("root", "a", "b", "text", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _group((key[1].as_py(), key[2].as_py()), rows, k, threshold)

    found = settle(pairs.groupBy("root", "i", "j").applyInArrow(run, "a bigint, b bigint, links bigint, root_a bigint, root_b bigint"), "links")
    links = found.groupBy("a", "b").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.struct("a", "b").alias("u"), F.struct(F.col("root_a").alias("a"), F.col("root_b").alias("b")).alias("v")), "groups")
    member = settle(groups.select(F.col("u.a").alias("a"), F.col("u.b").alias("b"), "root").join(classes.select("a", "b", "class_id"), ["a", "b"]), "member")
    lowest = settle(member.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("rows")), "lowest")
    grouped = settle(by_key(member, lowest, ["root"], "rows", F.xxhash64("a", "b")).join(links, ["a", "b"]).select("a", "b", "n_links", "group_id", "root"), "grouped")
    whole = classes.select("a", "b", "class_id", "class_size").join(grouped, ["a", "b"], "left")
    whole = whole.select("a", "b", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("root", F.struct("a", "b")).alias("root"))
    whole = settle(whole, "whole")
    discard(signed, classes, edges, met, dealt, found, member, lowest, grouped)
    return rows, whole, odd


def jaccard_join(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: id, class_id, class_size, n_links and group_id."""
    rows, classes, _ = similar(docs, text, id, k, threshold)
    return by_key(rows, classes, ["a", "b"], "class_size", F.monotonically_increasing_id()).select(F.col("id").alias(id), "class_id", "class_size", "n_links", "group_id")


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each connected group, the one with the smallest id.

    Where ids are null or repeated, rows are told apart by their texts and one of
    the equal rows stays.
    """
    rows, classes, odd = similar(docs, text, id, k, threshold)
    if not odd:
        every = by_key(rows, classes, ["a", "b"], "class_size", F.monotonically_increasing_id())
        gone = settle(every.where("id != group_id").select(F.col("id").alias(free(docs, "_gone")[0])), "gone")
        return docs.join(small(gone), col(id) == F.col(gone.columns[0]), "left_anti")
    columns = docs.columns
    named = [f"c{i}" for i in range(len(columns))]  # so that no column of the table can clash with one of ours
    plain = docs.toDF(*named)
    of = lambda name: named[columns.index(name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.column_bytes(batch.column(columns.index(text)))
            pairs = [digest(W.shingles(W.words(raw[offsets[r] : offsets[r + 1]])[2], k)) for r in range(batch.num_rows)]
            a, b = (pa.array([p[s] for p in pairs], type=pa.int64()) for s in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, a, b], names=[*named, "a", "b"])

    keyed = batched(plain).mapInArrow(run, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(named, docs.schema, strict=True)) + ", a bigint, b bigint")
    first = F.struct(F.col(of(id)).isNull(), F.col(of(id)), F.xxhash64(*[F.col(x).cast("string") for x in named]))
    kept = by_key(keyed, classes.select("a", "b", "root", "class_size"), ["a", "b"], "class_size", F.monotonically_increasing_id()).groupBy("root").agg(F.min_by(F.struct(*named), first).alias("_row"))
    return kept.select(*[F.col(f"_row.{n}").alias(c) for n, c in zip(named, columns, strict=True)])


def op9_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bayes_jaccard_join": op9_bayes_jaccard_join}
SQL: dict[str, str] = {}
