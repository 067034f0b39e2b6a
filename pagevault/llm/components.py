"""Connected components of an edge table by alternating star contractions.

Each round hooks every neighbour to the smallest one (large star, then small
star), so the number of rounds grows with the logarithm of the longest path, not
with the path.  A vertex's edges are only ever reduced to a minimum and joined
back, never gathered.  Every round is settled in the shared folder, and so are
the minima: as tables of their own they are joined by broadcast while they are
small, and beyond that by a shuffle whose hot vertices AQE can split.

Defined results: edges with a null end, loops and repeated edges are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm.store import discard, settle


def _large(e: DataFrame, name: str) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    out = settle(both.join(low, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
    discard(low)
    return out


def _small(e: DataFrame, name: str) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = settle(down.groupBy("u").agg(F.min("v").alias("m")), name)
    out = settle(down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
    discard(low)
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (u, v) to rows (u, root) for every vertex with an edge; the root is the component's smallest vertex."""
    e = settle(edges.where("u != v").select("u", "v").distinct(), name)
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == seen:
            break
        seen = now
        hooked = _large(e, name)
        new = _small(hooked, name)
        discard(e, hooked)
        e = new
    return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
