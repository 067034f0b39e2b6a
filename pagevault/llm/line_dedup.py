"""Site-relative line deduplication, in DataFrame operations only.

A line is boilerplate on a host if the pages of that host that contain it,
divided by all pages of that host, exceed ``ratio`` and it stands on at least
``min_pages`` pages there.  Boilerplate lines are dropped from every page of
the host; the other lines keep their order.

Scale: each page's distinct lines are hashed to 128 bits, pre-aggregated in the
map tasks and counted by (host, line), so a host with a third of all pages is
spread over its lines and a line on every page arrives as one partial count per
task.  What remains of a host is its list of boilerplate lines, of which there
can be no more than the mean distinct lines a page divided by ``ratio``,
however many pages it has.  Those lists are settled and broadcast only if all their lines
together are few by count (``BROADCAST_LINES``); otherwise they are joined by
host and one of ``SALTS`` numbers, with a copy of the list for each, so that a
hot host's texts are spread too.  Texts are never shuffled on the broadcast way.
A text's lines meet the list once, as a hashed set intersection; only lines that
hit it are compared key by key.

Defined results: a null text stays null, has no lines and still counts as a
page; an empty text stays empty; a null host is a host of its own; blank lines
are never boilerplate; repeated rows are separate pages; a page of nothing but
boilerplate becomes an empty text.  Other columns pass through unchanged, but
for those that carry the name of a requested count, which the count replaces;
``text`` and ``host`` may not be such names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm.store import col, content, free, is_small, others, settle, table

RATIO = 0.05
MIN_PAGES = 5
BROADCAST_LINES = 300_000  # 40 bytes each: the most lines that are broadcast, over all hosts
SALTS = 32


def _key(line: Column) -> Column:
    a, b = content(line)
    return F.struct(a.alias("a"), b.alias("b"))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, once: bool = False) -> DataFrame:
    """Per host that has any: ``_host`` and ``_lines``, the keys of its boilerplate lines.

    With ``once`` the equal texts of a host count as one page.
    """
    pages = docs.select(col(host).alias("_host"), col(text).alias("_text"), *([_key(col(text)).alias("_page")] if once else []))
    totals = (pages.select("_host", "_page").distinct() if once else pages).groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    lines = pages.withColumn("_line", F.explode(F.array_distinct(F.split("_text", "\n")))).where(F.trim("_line") != "").withColumn("_key", _key(F.col("_line")))
    if once:  # by page first, so that no line's pages meet in one task
        lines = lines.select("_host", "_key", "_page").distinct()
    counts = lines.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages)
    t = totals.withColumnRenamed("_host", "_of")
    return counts.join(t, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_pages") / F.col("_total") > ratio).groupBy("_host").agg(F.collect_list("_key").alias("_lines"))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None, once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``; ``counts`` names columns for lines and dropped lines, ``once`` counts equal texts as one page."""
    of, bad, salt, copy, split = free(docs, "_of", "_bad", "_salt", "_copy", "_split")
    lists = settle(boilerplate(docs, text, host, ratio, min_pages, once), "boilerplate").select(F.col("_host").alias(of), F.col("_lines").alias(bad))
    if is_small(lists, BROADCAST_LINES, F.size(bad)):
        both = docs.join(F.broadcast(lists), col(host).eqNullSafe(F.col(of)), "left")
    else:
        lists = lists.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = docs.withColumn(salt, F.pmod(content(col(text))[1], F.lit(SALTS)).cast("int"))
        both = both.join(lists, col(host).eqNullSafe(F.col(of)) & (F.col(salt) == F.col(copy)), "left")
    # a line is looked for in the list by key only if its first hash is among those that text and list share
    parts = F.transform(F.split(col(text), "\n"), lambda x: F.struct(x.alias("x"), _key(x).alias("k")))
    shared = F.array_intersect(F.transform(F.col(f"{split}.p"), lambda p: p["k"]["a"]), F.transform(F.col(bad), lambda k: k["a"]))
    both = both.withColumn(split, F.when(F.col(bad).isNotNull() & col(text).isNotNull(), F.struct(parts.alias("p")))).withColumn(split, F.when(F.col(split).isNotNull(), F.struct(F.col(f"{split}.p").alias("p"), shared.alias("s"))))
    kept = F.filter(F.col(f"{split}.p"), lambda p: ~(F.array_contains(F.col(f"{split}.s"), p["k"]["a"]) & F.array_contains(F.col(bad), p["k"])))
    cut = both.withColumn(split, F.when(F.col(split).isNotNull(), F.struct(F.size(F.col(f"{split}.p")).alias("n"), F.transform(kept, lambda p: p["x"]).alias("k"))))
    new = F.when(F.col(split).isNull(), col(text)).otherwise(F.array_join(F.col(f"{split}.k"), "\n"))
    columns = [new.alias(c) if c == text else col(c) for c in others(docs, *(counts or ()))]
    if counts:
        lines = F.coalesce(F.col(f"{split}.n"), F.size(F.split(col(text), "\n")), F.lit(0))
        columns += [F.when(col(text).isNull(), F.lit(0)).otherwise(lines).cast("long").alias(counts[0]), F.coalesce(F.col(f"{split}.n") - F.size(F.col(f"{split}.k")), F.lit(0)).cast("long").alias(counts[1])]
    return cut.select(*columns)


def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=("n_lines", "n_dropped"))


SQL_TEXT = f"""
WITH p AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
l AS (SELECT rid, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM p WHERE text IS NOT NULL),
c AS (SELECT source, line, count(DISTINCT rid) AS pages FROM l WHERE trim(line) <> '' GROUP BY source, line),
b AS (SELECT c.source, c.line, true AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE c.pages >= {MIN_PAGES} AND c.pages::DOUBLE / t.total > {RATIO}),
k AS (SELECT l.rid, count(*) AS n_lines, count(b.bad) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.bad IS NULL), '') AS text
      FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.rid)
SELECT p.doc_id, p.source, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped FROM p LEFT JOIN k ON p.rid = k.rid
"""

QUERIES = {"op2_site_line_dedup": op2_site_line_dedup}
SQL = {"op2_site_line_dedup": SQL_TEXT}
