"""Near-duplicate embeddings: all pairs of vectors with a cosine at the threshold or more.

1. Rows with the same components form a class; only classes go on, with their
   number of rows as weight, so exact copies never meet each other.
2. The second moments of the unit vectors are summed in Spark; their
   eigenvectors (a d x d matrix) turn every vector so that leading dimensions
   hold most of its length (PCA without centring: cosines stay as they are).
3. The classes are dealt into tiles of ``TILE`` vectors, and every two tiles meet
   in one group.  There products of the leading dimensions are summed for whole
   blocks first; what the other dimensions can add is at most the product of
   both suffix norms (Cauchy-Schwarz), and a pair that cannot reach the threshold
   any more stops.  What is left goes on with twice as many dimensions, and at
   the end is computed from the vectors as given: a pair is linked if its cosine
   in double precision is at the threshold or more.
4. A group returns, for each class with a link, the rows it is linked to and the
   smallest class connected to it there; never the pairs.  Counts are summed and
   components connected (``components``).

Scale: all pairs of n classes are compared, as exact search in many dimensions
asks: n**2 / 2 products of a few leading dimensions, spread over (n / TILE)**2 / 2
groups, each vector copied once a tile.  If leading dimensions spread wider than
what two linked vectors can differ by, they form a grid first, and only tiles of
neighbouring cells meet.  A group holds two tiles and one block of products,
however many vectors there are, are alike, or share a class; hot classes are one
row each.  Lost tasks are computed again from settled tables.

Defined results: a vector that is null, empty, all zeros or holds a null or
non-finite component links with nothing, and so does a pair of vectors of
different lengths; a null id stays null and names a component only if all ids in
it are null; repeated rows are members of one class, hence linked with each
other; with a repeated smallest id all its rows are kept; labels and other
columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault.llm.components import components
from pagevault.llm.ngram_join import by_key
from pagevault.llm.store import batched, col, content, discard, settle, table

THRESHOLD = 0.9
TILE = 8192  # vectors of a tile (fewer if they are long: TILE_BYTES)
TILE_BYTES = 1 << 26
TILES = 8  # tiles that all vectors of a length make at least
BLOCK = 1024  # rows and columns of a block of products
LEAD = 16  # leading dimensions that are summed first
GRID = 3  # leading dimensions that can form a grid, at most
ROTATED = 16  # lengths of vectors for which axes are computed; others keep their own axes, which is only slower
SLACK = 1e-9  # by which bounds are loosened for rounding


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which loses nothing, so that no square is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(moments: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those that hold most of the vectors' lengths first."""
    values, vectors = np.linalg.eigh(moments)
    return vectors[:, np.argsort(-values, kind="stable")]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def links(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float = THRESHOLD, same: bool = False, lead: int = LEAD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two matrices with a cosine at the threshold or more, block by block; ``same``: of one matrix, each pair once."""
    x, y = scaled(x), scaled(y)
    nx, ny = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
    px, py = x / nx[:, None] @ turn, y / ny[:, None] @ turn
    d = px.shape[1]
    steps = [0]
    while steps[-1] < d:
        steps.append(min(d, max(lead, 2 * steps[-1])))
    # norms of what follows after each step
    after = lambda p: [np.sqrt(np.maximum(0, 1 - (p[:, :m] ** 2).sum(axis=1))) for m in steps[1:]]
    sx, sy = after(px), after(py)
    for a in range(0, len(x), BLOCK):
        for b in range(a if same else 0, len(y), BLOCK):
            r, c = slice(a, a + BLOCK), slice(b, b + BLOCK)
            sums = px[r, : steps[1]] @ py[c, : steps[1]].T
            i, j = np.nonzero(sums + np.outer(sx[0][r], sy[0][c]) >= threshold - SLACK)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            s = sums[i, j]
            i, j = i + a, j + b
            for k in range(1, len(steps) - 1):
                if not len(i):
                    break
                cut = slice(steps[k], steps[k + 1])
                if 8 * len(i) > sums.size:  # as whole blocks while many pairs are left
                    s = s + (px[r, cut] @ py[c, cut].T)[i - a, j - b]
                else:
                    s = s + _products(px[:, cut], py[:, cut], i, j)
                on = s + sx[k][i] * sy[k][j] >= threshold - SLACK
                i, j, s = i[on], j[on], s[on]
            if not len(i):
                continue
            # rotation moves a product by less than SLACK: what is that near the threshold is judged by the vectors as given
            open_ = np.flatnonzero(np.abs(s - threshold) <= SLACK)
            s[open_] = _products(x, y, i[open_], j[open_]) / (nx[i[open_]] * ny[j[open_]])
            on = s >= threshold
            yield i[on], j[on]


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of pairs of rows, a bounded number at once."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        cut = slice(lo, lo + (1 << 14))
        out[cut] = np.einsum("ij,ij->i", x[i[cut]], y[j[cut]])
    return out


class Forest:
    """Connected vertices 0 to n - 1, the smallest of each component its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def _compare(left: int, right: int, rows: pa.Table, turn: np.ndarray | None, threshold: float) -> pa.Table:
    """Weights linked to and local roots of the classes of two tiles."""
    a, b, weight = (rows[x].to_numpy() for x in ("a", "b", "weight"))
    order = np.lexsort((b, a))
    rows, a, b, weight = rows.take(pa.array(order)), a[order], b[order], weight[order]
    tile, x = rows["tile"].to_numpy(), matrix(rows["vector"])
    turn = np.eye(x.shape[1]) if turn is None else turn
    one, two = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    count, forest = np.zeros(len(a), dtype=np.int64), Forest(len(a))
    if len(one) and len(two):
        for i, j in links(x[one], x[one] if left == right else x[two], turn, threshold, left == right):
            i, j = one[i], two[j]
            for u, v in ((i, j), (j, i)):
                count += np.rint(np.bincount(u, weights=weight[v], minlength=len(a))).astype(np.int64)
            forest.join(i, j)
    some = np.flatnonzero(count)
    root = forest.root[some]
    return pa.table({"a": a[some], "b": b[some], "links": count[some], "root_a": a[root], "root_b": b[root]})


def moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the outer products of the unit vectors, for the ``ROTATED`` commonest lengths: d x d numbers each, summed in Spark."""
    sizes = classes.groupBy("size").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "size").limit(ROTATED).collect()
    wanted = {r["size"] for r in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.column(0).to_numpy()
            for d in set(size.tolist()) & wanted:
                u = unit(matrix(batch.column(1).filter(pa.array(size == d))))
                held[d] = held.get(d, 0) + u.T @ u
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, type=pa.int32()), pa.array(np.arange(d), type=pa.int32()), pa.array(list(m), type=pa.list_(pa.float64()))], names=["size", "row", "m"])

    parts = batched(classes).select("size", "vector").mapInArrow(run, "size int, row int, m array<double>")
    cells = parts.select("size", "row", F.posexplode("m").alias("column", "value")).groupBy("size", "row", "column").agg(F.sum("value").alias("value"))
    out = {d: np.zeros((d, d)) for d in wanted}
    for r in cells.collect():
        out[r["size"]][r["row"], r["column"]] = r["value"]
    return out


def tiled(classes: DataFrame, turns: dict[int, np.ndarray], spread: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """The classes with their cell: of the leading dimensions in which vectors spread wider than linked ones can differ."""
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    wide = {d: [k for k in range(min(GRID, d)) if spread[d][k] > reach / 2] for d in turns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(0).to_numpy()
            cell = np.zeros((batch.num_rows, GRID), dtype=np.int32)
            for d in set(size.tolist()) & {d for d in wide if wide[d]}:
                at = np.flatnonzero(size == d)
                p = unit(matrix(batch.column(4).take(pa.array(at)))) @ turns[d][:, wide[d]]
                cell[at[:, None], np.arange(len(wide[d]))] = np.floor(p / reach)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cell), type=pa.list_(pa.int32()))], names=["size", "a", "b", "weight", "vector", "cell"])

    return batched(classes).select("size", "a", "b", "weight", "vector").mapInArrow(run, "size int, a bigint, b bigint, weight bigint, vector " + classes.schema["vector"].dataType.simpleString() + ", cell array<int>")


def near_duplicates(vectors: DataFrame, vector: str = "embedding", id: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``vectors``: its id, ``n_links``, ``component_id`` and ``kept``."""
    given = batched(vectors).select(col(id).alias("id"), col(vector).alias("vector"))
    sound = "vector IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x != 0)"
    rows = given.withColumn("ok", F.coalesce(F.expr(sound), F.lit(False)))
    rows = settle(rows.select("id", *(F.when(F.col("ok"), x).alias(c) for c, x in zip("ab", content(F.col("vector")), strict=True)), "vector"), "vectors")
    classes = rows.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    classes = settle(classes.select("a", "b", "least", "weight", "vector", F.size("vector").alias("size")), "classes")
    sums = moments(classes)
    turns = {d: axes(m) for d, m in sums.items()}
    spread = {d: np.sqrt(np.maximum(0, np.diag(turns[d].T @ m @ turns[d])) / max(1e-300, np.trace(m))) for d, m in sums.items()}
    placed = settle(tiled(classes, turns, spread, threshold), "placed")
    cells = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("rows"))
    room = F.least(F.lit(TILE), F.greatest(F.lit(256), F.floor(F.lit(TILE_BYTES) / (8 * F.col("size")))))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("size"))  # there are 6**GRID cells a length at most
    cells = settle(cells.select("size", "cell", F.greatest(F.ceil(TILES * share), F.ceil(F.col("rows") / room)).cast("int").alias("tiles")), "cells")
    # cells meet themselves and those that differ by one step at most
    steps = F.array(*[F.array(*map(F.lit, by)) for by in product((-1, 0, 1), repeat=GRID)])
    stepped = cells.select("size", "cell", "tiles", F.explode(steps).alias("by")).withColumn("other", F.zip_with("cell", "by", lambda c, s: c + s))
    known = cells.select("size", F.col("cell").alias("other"), F.col("tiles").alias("tiles_other"))
    met = settle(stepped.join(known, ["size", "other"]).select("size", "cell", "tiles", "other", "tiles_other"), "neighbours")
    dealt = placed.join(met, ["size", "cell"]).withColumn("mine", F.pmod(F.xxhash64("a", "b"), F.col("tiles")).cast("int")).withColumn("theirs", F.explode(F.expr("sequence(0, tiles_other - 1)")))
    flip = F.struct("cell", "mine") > F.struct(F.col("other").alias("cell"), F.col("theirs").alias("mine"))
    dealt = dealt.select(
        "size", F.when(flip, F.struct("other", "theirs", "cell", "mine")).otherwise(F.struct(F.col("cell").alias("other"), F.col("mine").alias("theirs"), F.col("other").alias("cell"), F.col("theirs").alias("mine"))).alias("pair"),
        F.when(flip, 1).otherwise(0).alias("tile"), F.expr("cell = other AND mine = theirs").alias("alone"), "a", "b", "weight", "vector",
    )

    def run(key: tuple, group: pa.Table) -> pa.Table:
        alone = group["alone"][0].as_py()
        return _compare(0, 0 if alone else 1, group, turns.get(key[0].as_py()), threshold)

    found = settle(dealt.groupBy("size", "pair").applyInArrow(run, "a bigint, b bigint, links bigint, root_a bigint, root_b bigint"), "links")
    counts = found.groupBy("a", "b").agg(F.sum("links").alias("links"))
    of = components(found.select(F.struct("a", "b").alias("u"), F.struct(F.col("root_a").alias("a"), F.col("root_b").alias("b")).alias("v")), "linked")
    named = classes.select("a", "b", "least", "weight")
    member = settle(of.select(F.col("u.a").alias("a"), F.col("u.b").alias("b"), "root").join(named, ["a", "b"]), "member")
    lowest = settle(member.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("rows")), "lowest")
    grouped = by_key(member, lowest, ["root"], "rows", F.xxhash64("a", "b")).select("a", "b", "component")
    whole = named.join(counts, ["a", "b"], "left").join(grouped, ["a", "b"], "left")
    whole = settle(whole.select("a", "b", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")), "whole")
    discard(classes, placed, cells, met, found, member, lowest)
    linked = by_key(rows.where("a IS NOT NULL").select("id", "a", "b"), whole, ["a", "b"], "weight", F.monotonically_increasing_id()).select("id", "n_links", "component")
    alone = rows.where("a IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op11_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL_TEXT = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS component_id,
  (SELECT min(b) FROM r WHERE r.a = v.vec_id) = v.vec_id AS kept FROM v
"""

QUERIES = {"op11_embedding_near": op11_embedding_near}
SQL = {"op11_embedding_near": SQL_TEXT}
