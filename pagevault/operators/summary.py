"""Archive statistics on several levels at once, and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagevault import schemas as S

LEVELS = ("site", "domain", "day")


def site(domain):
    """The last two labels of a domain."""
    return F.coalesce(F.nullif(F.regexp_extract(domain, r"[^.]+\.[^.]+$", 0), F.lit("")), domain)


def overview(archive: DataFrame, cube: bool = False) -> DataFrame:
    """Pages, pinned ones, and first and last date by (site, domain, day), with all their subtotals.

    ``level`` is the grouping id: a bit for each of the three that a row sums over.  With
    ``cube`` every combination is summed, else each with its leaders.  Partial sums are made
    before the shuffle, so that a site with a third of all pages is a row a task and day.
    """
    rows = archive.withColumns({"site": site(F.col("domain")), "day": F.floor(F.col("last_seen") / S.DAY_MS)})
    grouped = rows.cube(*LEVELS) if cube else rows.rollup(*LEVELS)
    return grouped.agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("pages"), F.count_if("pinned").alias("pinned"), F.min("last_seen").alias("oldest"), F.max("last_seen").alias("newest"),
    )


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], prefix: str = "last_", span: int = S.HOUR_MS) -> DataFrame:
    """Each left row with the values of the key's last right row at or before it (null if there is none).

    ``at`` is a time in milliseconds, ``values`` are columns of the right.  Both sides are cut
    into spans of time: inside a span rows are merged in order, and from span to span only
    the last right row of a span is handed on, so a key with very many rows is spread over
    its spans, and no range of times is ever joined.  Right rows at one time count in the
    order of their values; a null key has no last row.
    """
    own, held = "_left", "_right"
    both = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*left.columns).alias(own), F.lit(None).alias(held))
    other = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(None).alias(own), F.struct(*values).alias(held))
    both = both.unionByName(other).withColumn("_span", F.floor(F.col("_at") / span))
    ends = both.groupBy("_key", "_span").agg(F.max(F.when(F.col(held).isNotNull(), F.struct("_at", held)))[held].alias("_end"))
    along = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("_key", "_span", F.last("_end", ignorenulls=True).over(along).alias("_before"))
    inside = Window.partitionBy("_key", "_span").orderBy("_at", F.col(own).isNotNull(), held).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_now", F.last(held, ignorenulls=True).over(inside)).where(F.col(own).isNotNull())
    met = met.join(handed.withColumnsRenamed({"_key": "_k", "_span": "_s"}), F.col("_key").eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")), "left").withColumn("_found", F.coalesce("_now", "_before"))
    return met.select(f"{own}.*", *(F.col(f"_found.{v}").alias(f"{prefix}{v}") for v in values))
