"""The archive as a table: scans, upserts and deletes.

Every mutation is a new DataFrame; ``streaming.ingest`` and callers write it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault.functions import text as X
from pagevault.functions import urls as U
from pagevault.operators.scratch import settle, small

META = ("id", "url", "domain", "first_seen", "last_seen", "bytes", "pinned")


def recent(archive: DataFrame, limit: int = S.PAGE) -> DataFrame:
    return archive.orderBy(F.desc("last_seen"), F.desc("id")).limit(limit)


def oldest(archive: DataFrame, limit: int = 500, before: int | None = None, skip_pinned: bool = False) -> DataFrame:
    rows = archive if before is None else archive.where(F.col("last_seen") < before)
    return (rows.where(~F.col("pinned")) if skip_pinned else rows).orderBy("last_seen", "id").limit(limit)


def oldest_first_seen(archive: DataFrame) -> DataFrame:
    return archive.agg(F.min("first_seen").alias("first_seen"))


def on_site(site: str) -> Column:
    """The domain itself or anything under it; nothing for an empty site."""
    s = site.lower().removeprefix("www.")
    d = F.col("domain")
    return F.lit(False) if not s else F.coalesce((d == s) | d.endswith("." + s), F.lit(False))


def between(low: int, high: int) -> Column:
    return (F.col("last_seen") >= low) & (F.col("last_seen") < high)


def after(archive: DataFrame, id: int | None = None, limit: int = 100) -> DataFrame:
    """Keyset pagination: the next pages after an id (None starts)."""
    return (archive if id is None else archive.where(F.col("id") > id)).orderBy("id").limit(limit)


def by_url(archive: DataFrame, url: str) -> DataFrame:
    return archive.where(F.col("url_key") == U.url_key(F.lit(url)))


def many(archive: DataFrame, ids: DataFrame) -> DataFrame:
    return archive.join(ids.select("id"), "id", "left_semi")


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete from the archive or from postings; ids that are not there don't matter."""
    return table.join(ids.select("id"), "id", "left_anti")


def marked(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with ``_marked``: whether a row's id is given.  Rows stay where they are, so they are not shuffled by id.

    Ids are marked as bits, 64 to a row; rows of marks are broadcast if they are counted as few.
    """
    bit = lambda c: F.col(c).bitwiseAND(63).cast("int")
    marks = ids.select(F.shiftright("id", 6).alias("_of"), F.call_function("shiftleft", F.lit(1).cast("long"), bit("id")).alias("_bit"))
    marks = settle(marks.groupBy("_of").agg(F.bit_or("_bit").alias("_bits")), "marks")
    met = table.withColumn("_of", F.shiftright("id", 6)).join(small(marks), "_of", "left")
    return met.select(*table.columns, (F.col("_bits").isNotNull() & (F.getbit("_bits", bit("id")) == 1)).alias("_marked"))


def unposted(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """``without`` for postings: a page has hundreds."""
    return marked(postings, ids).where(~F.col("_marked")).drop("_marked")


def pin(archive: DataFrame, id: int, value: bool = True) -> DataFrame:
    return archive.withColumn("pinned", F.when(F.col("id") == id, F.lit(value)).otherwise(F.col("pinned")))


def keyed(pages: DataFrame) -> DataFrame:
    """Incoming pages with key, domain and hash; addresses that are not http(s) are left out."""
    rows = pages.withColumns({"url_key": U.url_key(F.col("url")), "domain": U.domain_of(F.col("url")), "title": F.coalesce("title", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    return rows.where(F.col("url_key").isNotNull()).withColumn("content_hash", X.content_hash(X.indexed_text(F.col("title"), F.col("text"))))


PARTS = 1000


def numbered(rows: DataFrame, by: str, then: str) -> DataFrame:
    """Rows with ``number``, from 1 in the order of two columns, the first a number.

    The range of the first is cut into ``PARTS`` parts; rows are numbered inside their
    part and moved on by the counts of the parts before, so no task orders them all.
    """
    ends = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    x = F.col(by).cast("double")
    lo, hi = ends.select("lo").scalar().cast("double"), ends.select("hi").scalar().cast("double")
    parts = rows.withColumn("_part", F.when(hi > lo, F.floor((x - lo) / (hi - lo) * (PARTS - 1))).otherwise(0))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy(F.asc_nulls_first("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by, then))
    met = parts.withColumn("_place", place).join(before.withColumnRenamed("_part", "_of"), F.col("_part").eqNullSafe(F.col("_of")))
    return met.withColumn("number", F.col("_place") + F.col("_before")).drop("_part", "_place", "_of", "_before")


def matching(archive: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of the pages whose key is given; of the archive only two columns are read."""
    return archive.select("id", "url_key").join(keys.select("url_key").distinct(), "url_key", "left_semi").select("id")


def last_id(archive: DataFrame) -> int:
    return archive.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def folded(rows: DataFrame, held: DataFrame, order: str = "arrival") -> DataFrame:
    """What the settled incoming rows of each key come to: one narrow row a key.

    ``rows`` have ``keyed``'s columns and ``_row``, a number of their own; ``held`` the keys
    and hashes of the archive.  ``n_row`` is the row whose content stands in the end, if the
    content changes at all; the other columns are as ``upsert`` uses them.

    Rows are ranged by key and arrival, so that a key with many rows is cut into
    stretches.  Each stretch is summed by itself (its end, its rows, the last change and the
    rows after it); stretches of a key are then put together in order.  No task sees more
    of a key than a stretch, or one row for each of its stretches.
    """
    narrow = rows.select("url_key", F.col(order).alias("_at"), "_row", "content_hash", "last_seen", "first_seen", "visit_count", "pinned")
    cut = settle(narrow.repartitionByRange("url_key", "_at").withColumn("_stretch", F.spark_partition_id()), "stretches")
    inside = Window.partitionBy("url_key", "_stretch").orderBy("_at", "_row")
    ends = cut.groupBy("url_key", "_stretch").agg(F.max_by("content_hash", F.struct("_at", "_row")).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy("url_key").orderBy("_stretch")
    ends = ends.join(held.select("url_key", F.col("content_hash").alias("_hash"), F.lit(True).alias("_held")), "url_key", "left")
    later = F.coalesce(F.sum("_rows").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    ends = ends.select("url_key", "_stretch", F.coalesce(F.lag("_last").over(along), "_hash").alias("_before"), "_held", "_rows", later.alias("_later"))
    at = cut.withColumn("_n", F.row_number().over(inside)).withColumn("_prior", F.lag("content_hash").over(inside)).join(ends, ["url_key", "_stretch"])
    at = at.withColumn("_changed", ~F.coalesce("_prior", "_before").eqNullSafe(F.col("content_hash")))
    when = lambda condition, *c: F.max(F.when(condition, F.struct("_at", "_row", *c)))
    changed = F.col("_changed")
    # a given visit count restarts the count where the content changed; the rows after it count on
    restart = (F.col("visit_count") + F.col("_rows") - F.col("_n") + F.col("_later")).alias("v")
    sums = at.groupBy("url_key", "_stretch").agg(
        when(changed).alias("row"), when(changed & F.col("first_seen").isNotNull(), "first_seen").alias("first"), when(changed & F.col("visit_count").isNotNull(), restart).alias("restart"),
        F.min(F.struct("_at", "_row", "last_seen", "pinned")).alias("born"), F.max("last_seen").alias("seen"), F.count(F.lit(1)).alias("rows"), F.first("_held").alias("held"),
    )
    whole = sums.groupBy("url_key").agg(*(F.max(c).alias(c) for c in ("row", "first", "restart", "seen")), F.min("born").alias("born"), F.sum("rows").alias("rows"), F.first("held").alias("held"))
    return whole.select(
        "url_key", F.col("row._row").alias("n_row"), F.col("seen").alias("n_seen"), F.col("first.first_seen").alias("n_first"), F.col("born.last_seen").alias("n_born"), F.col("born.pinned").alias("n_pinned"),
        F.col("restart.v").alias("n_restart"), F.col("rows").alias("n_rows"), F.when(F.col("held").isNull(), F.col("born._at")).alias("n_arrival"),
    )


def upsert(archive: DataFrame, pages: DataFrame, order: str = "arrival", top: int | None = None) -> DataFrame:
    """Fold incoming pages (``schemas.PAGE_INPUT`` and an arrival number) into the archive.

    The archive may be a part of one, as long as it holds every page whose key
    comes in; then ``top`` is the last id of the whole.

    Pages of one key are folded in order of arrival: the same content counts a
    visit; other content replaces the text in place (same id, first seen and pin
    kept unless given); last seen never moves back.  New pages get the next ids
    in order of arrival.

    Narrow columns are folded first (``folded``); a text is moved only if it stands in
    the end.
    """
    rows = settle(keyed(pages).withColumn("_row", F.monotonically_increasing_id()), "incoming")
    new = settle(folded(rows, archive, order), "folded")
    texts = rows.select("_row", *(F.col(c).alias(f"n_{c}") for c in ("url", "title", "domain", "text", "content_hash")))
    new = new.join(texts, F.col("n_row") == F.col("_row"), "left").drop("_row", "n_row")
    top = archive.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if top is None else F.lit(top)
    ids = numbered(new.where("n_arrival IS NOT NULL").select("url_key", "n_arrival"), "n_arrival", "url_key").select("url_key", (F.col("number") + top).cast("long").alias("id"))
    lang = "lang" if "lang" in archive.columns else F.lit(None).cast("string").alias("lang")
    kept = archive.join(new, "url_key", "left")
    visits = F.when(F.col("n_rows").isNull(), F.col("visit_count")).otherwise(F.coalesce("n_restart", F.coalesce("visit_count", F.lit(0)) + F.col("n_rows"))).cast("int")
    pick = lambda c: F.coalesce(f"n_{c}", c).alias(c)
    kept = kept.select(
        "url_key", "id", *map(pick, ("url", "title", "domain", "text", "content_hash")), F.coalesce("n_first", "first_seen", "n_born").alias("first_seen"), F.greatest("last_seen", "n_seen").alias("last_seen"),
        visits.alias("visit_count"), F.coalesce("pinned", "n_pinned", F.lit(False)).alias("pinned"), lang,
    )
    fresh = new.where("n_arrival IS NOT NULL").join(ids, "url_key")
    fresh = fresh.select(
        "url_key", "id", *(F.col(f"n_{c}").alias(c) for c in ("url", "title", "domain", "text", "content_hash")), F.coalesce("n_first", "n_born").alias("first_seen"), F.col("n_seen").alias("last_seen"),
        F.coalesce("n_restart", "n_rows").cast("int").alias("visit_count"), F.coalesce("n_pinned", F.lit(False)).alias("pinned"), F.lit(None).cast("string").alias("lang"),
    )
    return kept.unionByName(fresh).withColumn("excerpt", X.excerpt(F.col("text")))


def shrinks(old: Column, new: Column, explicit: Column | None = None) -> Column:
    """Whether a changed page lost so much that the old text should stay."""
    a, b = F.length(F.trim(F.coalesce(old, F.lit("")))), F.length(F.trim(F.coalesce(new, F.lit(""))))
    return ~(F.lit(False) if explicit is None else explicit) & (a >= S.SHRINK_CHARS) & (b < a * S.SHRINK_SHARE)


def long_enough(title: Column, text: Column, explicit: Column | None = None) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    fine = (n >= S.MIN_TEXT) & (n >= F.length(F.coalesce(title, F.lit(""))) + S.OVER_TITLE)
    return (n > 0) & (fine if explicit is None else fine | explicit)


def is_read(focused_ms: Column, scroll: Column, words: Column, pdf: Column | None = None) -> Column:
    short = (words > 0) & (words <= S.SHORT_WORDS)
    enough = short | (scroll >= S.SCROLL)
    return F.coalesce((focused_ms >= S.DWELL_MS) & (enough if pdf is None else pdf | enough), F.lit(False))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def keys(archive: DataFrame) -> DataFrame:
    """Every page's id and key."""
    return archive.select("id", "url_key")


def removed(archive: DataFrame, ids: DataFrame, batches: int = 1) -> list[DataFrame]:
    """Delete in so many steps, by a hash of the id: the archive after each.  Whoever stops between steps keeps what was done."""
    gone = ids.select("id").distinct().withColumn("_step", F.pmod(F.xxhash64("id"), F.lit(batches)))
    return [without(archive, gone.where(F.col("_step") <= i)) for i in range(batches)]


def deletion(archive: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many of the ids are pages, and the bytes they free."""
    return many(archive, ids).agg(F.count(F.lit(1)).alias("deleted"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_freed"))


def not_before(at: Column, now: int) -> Column:
    """A claimed date that counts: not in the future, and now where there is none."""
    return F.when(at > 0, F.least(at, F.lit(now))).otherwise(F.lit(now))


def import_status(rows: DataFrame, archive: DataFrame, excluded: Column, now: int) -> DataFrame:
    """Import rows with ``status`` (failed, excluded, skipped, imported) and dates clamped to now."""
    r = rows.withColumn("url_key", U.url_key(F.col("url"))).withColumn("last_seen", F.when(F.col("last_seen") > 0, F.least("last_seen", F.lit(now))).otherwise(F.lit(now)))
    r = r.withColumn("first_seen", F.when(F.col("first_seen") > 0, F.least("first_seen", "last_seen")))
    r = r.join(archive.select("url_key", F.col("last_seen").alias("_held")), "url_key", "left")
    bad = F.col("url_key").isNull() | (F.coalesce("text", F.lit("")) == "")
    return r.withColumn("status", F.when(bad, "failed").when(excluded, "excluded").when(F.col("_held") >= F.col("last_seen"), "skipped").otherwise("imported")).drop("_held")
