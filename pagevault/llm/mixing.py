"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Source s with n_s of N documents and target weight w_s is repeated w_s * total /
n_s times on average, where total is ``scale`` * N.  A document's count is the
inverse of the Poisson distribution with that mean at a uniform number hashed
from (seed, document id); it is exploded by its count, and all copies are
shuffled by a hashed key and sorted by it in each partition, which is a
uniformly random order over the whole output.

The inverse is read from the source's cumulative distribution, an array built
once per source.  A mean above ``PART`` is the sum of equal parts of at most
``PART``, each with a uniform number of its own, so the array has TERMS entries
whatever the weights; beyond them a part's tail is under 2**-52, the grain of
the uniform numbers.

Rows are told apart by their ids.  Rows with a null or a repeated id are told
apart by id, content and the number of the occurrence among equal rows (equal
rows can't be told apart, so any order of them gives the same table), so each
row has a count and a place in the order of its own.

Scale: one aggregate over sources, one over ids, a join with the small table of
sources (broadcast only if its counted rows are few, by source otherwise), and
one shuffle of the output by a hash without ties, so neither a source with a
third of all rows nor one row repeated that often meets a single task: equal
rows are pre-aggregated to a number before they are shuffled, and numbered in
chunks of ``CHUNK`` that are dealt anew.  Where all ids are single, as they should
be, the texts are shuffled once.

Defined results: a null source is a source of its own; a null text passes
through; sources with weight 0 vanish; an empty table gives an empty result; other
columns pass through, but for those called ``copy`` or ``shuffle_key``, which the
results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm.store import col, free, others, settle, small, table

SEED = "mix-1"
PART = 32.0
TERMS = 128
CHUNK = 1024  # equal rows numbered by one task at a time


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) on a grid of 2**-52, from an md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """Per source: ``_of``, its number of parts and the cumulative distribution of one part.

    ``weights`` are target shares by source (any positive scale); None weighs all sources alike.
    """
    n = docs.groupBy(col(source).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        w = F.lit(1.0)
    else:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.coalesce(F.col("_of"), F.lit(""))), F.lit(0.0))
    whole = n.agg(F.struct(F.sum("_n").alias("n"), F.sum(w).alias("w"))).scalar()
    r = n.select("_of", (w / whole["w"] * whole["n"] * F.lit(scale) / F.col("_n")).alias("_rate"))
    r = r.where(F.col("_rate") > 0).select("_of", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int").alias("_parts"), "_rate")
    m = (F.col("_rate") / F.col("_parts")).alias("m")
    first = F.struct(F.exp(-m).alias("p"), F.array(F.exp(-m)).alias("c"))
    step = lambda acc, k: F.struct((acc["p"] * m / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * m / k)).alias("c"))
    return r.select("_of", "_rate", "_parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), first, step)["c"].alias("_cdf"))


def _named(docs: DataFrame, id: str, name: str) -> DataFrame:
    """``docs`` with ``name``, a string that no other row has: the id, or for null and repeated ids one made from id, content and occurrence."""
    many, n, chunk, occurrence = free(docs, "_many", "_n", "_chunk", "_occurrence")
    ids = docs.groupBy(col(id).alias(many)).agg(F.count(F.lit(1)).alias(n))
    odd = settle(ids.where((F.col(n) > 1) | F.col(many).isNull()).select(many), "odd-ids")
    whole = docs.withColumn(name, col(id).cast("string"))
    if odd.isEmpty():
        return whole
    on = col(id).eqNullSafe(F.col(many))
    fine = whole.join(small(odd), on, "left_anti")
    equal = docs.join(small(odd), on, "left_semi").groupBy(*[col(c) for c in docs.columns]).agg(F.count(F.lit(1)).alias(n))
    content = F.md5(F.to_json(F.struct(*[col(c) for c in docs.columns if c != id])))
    said = equal.withColumn(name, F.concat_ws(":", F.coalesce(col(id).cast("string"), F.lit("")), content))
    dealt = said.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / CHUNK)))).repartition(name, chunk)
    last = F.least(F.col(n), (F.col(chunk) + 1) * CHUNK)
    each = dealt.withColumn(occurrence, F.explode(F.sequence(F.col(chunk) * CHUNK + 1, last)))
    return fine.unionByName(each.select(*[col(c) for c in docs.columns], F.concat_ws(":", name, occurrence).alias(name)))


def mix(docs: DataFrame, source: str = "source", id: str = "doc_id", weights: dict[str, float] | None = None, scale: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` repeated to target weights, with ``copy`` (from 1) and ``shuffle_key``, in globally shuffled order."""
    docs = docs.select(*[col(c) for c in others(docs, "copy", "shuffle_key")])
    name, of, parts, cdf, count = free(docs, "_name", "_of_source", "_parts", "_cdf", "_count")
    per = small(settle(rates(docs, source, weights, scale), "rates").select(F.col("_of").alias(of), F.col("_parts").alias(parts), F.col("_cdf").alias(cdf)), 20_000)
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: _uniform(F.lit(seed), F.col(name), i))
    n = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    one = _named(docs, id, name).join(per, col(source).eqNullSafe(F.col(of))).select(*[col(c) for c in docs.columns], name, n.alias(count))
    many = one.where(F.col(count) > 0).select(*[col(c) for c in docs.columns], name, F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy"))
    out = many.select(*[col(c) for c in docs.columns], "copy", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, "copy")).alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def sql(docs: str = "documents", columns: str = "doc_id, source, text", seed: str = SEED) -> str:
    """DuckDB SQL for ``mix`` with equal weights over the relation ``docs``."""
    u = f"('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, ''), i)), 1, 13))::BIGINT / 4503599627370496.0"
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE * 1.0::DOUBLE / n::DOUBLE AS rate FROM n),
q AS (SELECT source, greatest(1, ceil(rate / {PART}))::INT AS parts, rate / greatest(1, ceil(rate / {PART}))::INT AS m FROM r),
t AS (SELECT source, parts, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM q
      UNION ALL SELECT source, parts, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM t WHERE k < {TERMS - 1}),
d AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cdf FROM t GROUP BY source),
w AS (SELECT x.*, d.cdf, unnest(range(1, d.parts + 1)) AS i, d.parts FROM (SELECT row_number() OVER () AS rid, {columns} FROM {docs}) x JOIN d ON x.source IS NOT DISTINCT FROM d.source),
c AS (SELECT rid, any_value(doc_id) AS doc_id, sum(len(list_filter(cdf, lambda z: z <= {u}))) AS n FROM w GROUP BY rid),
e AS (SELECT rid, unnest(range(1, n::INT + 1)) AS copy FROM c WHERE n > 0)
SELECT {", ".join("x." + c.strip() for c in columns.split(","))}, e.copy::INT AS copy, md5(concat_ws(':', '{seed}', 'order', coalesce(x.doc_id::VARCHAR, ''), e.copy)) AS shuffle_key
FROM e JOIN (SELECT row_number() OVER () AS rid, {columns} FROM {docs}) x ON e.rid = x.rid
"""


QUERIES = {"op7_poisson_mixing": op7_poisson_mixing}
SQL = {"op7_poisson_mixing": sql()}
