"""What happens to a page on its way in: candidates, captured contents and imports, a whole batch in one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault.functions import rules as R
from pagevault.functions import text as X
from pagevault.functions import urls as U
from pagevault.operators import index as I
from pagevault.operators import store as O
from pagevault.operators.scratch import settle

STILL_READING = "still reading"
NO_TEXT, LITTLE_TEXT = "nothing to index", "too little text to be worth finding later"
PAGE = ("url", "title", "text", "last_seen", "pinned", "first_seen", "visit_count")


def offers(candidates: DataFrame, policy: dict) -> DataFrame:
    """Candidates (url, has_password_field, focused_ms, scroll_depth, word_count, is_pdf) with ``capture`` and ``reason``."""
    said = R.reason(F.col("url"), password_field=F.coalesce("has_password_field", F.lit(False)), **policy)
    read = O.is_read(F.col("focused_ms"), F.col("scroll_depth"), F.col("word_count"), F.coalesce("is_pdf", F.lit(False)))
    why = F.when(F.col("url").isNull(), "no address").when(said != "ok", said).when(~read, STILL_READING).otherwise("read")
    return candidates.withColumn("reason", why).withColumn("capture", F.col("reason") == "read")


def contents(pages: DataFrame, archive: DataFrame, policy: dict, now: int) -> DataFrame:
    """Captured contents (arrival, url, canonical, title, text, captured_at, has_password_field, explicit) judged.

    Adds ``ok``, ``reason`` (``ok`` if kept), ``kept_older`` and the page as it is to be
    filed: ``filed`` (its canonical address, if the policy allows that one too),
    ``page_title``, ``page_text`` and ``last_seen``.  A page that comes back much smaller
    than it is held keeps the held text.  Contents of one batch are compared with the
    archive, not with each other.
    """
    no = F.lit(False)
    said = R.reason(F.col("url"), password_field=F.coalesce("has_password_field", no), **policy)
    c = pages.withColumn("_said", F.when(F.col("url").isNull(), "no address").otherwise(said)).withColumn("_canon", U.canonical_for(F.col("url"), F.coalesce("canonical", F.lit(""))))
    c = c.withColumns({"page_text": X.truncated(F.coalesce("text", F.lit(""))), "page_title": F.left(F.coalesce("title", F.lit("")), F.lit(S.TITLE_CHARS))})
    c = settle(c, "contents")  # or the address's parts would be parsed anew wherever they are used below
    c = settle(c.withColumn("filed", F.when((F.col("_canon") == F.col("url")) | (R.reason(F.col("_canon"), **policy) == "ok"), F.col("_canon")).otherwise(F.col("url"))), "filed").withColumn("_key", U.url_key(F.col("filed")))
    explicit = F.coalesce("explicit", no)
    fine = O.long_enough(F.col("page_title"), F.col("page_text"), explicit)
    c = c.withColumn("reason", F.when(F.col("_said") != "ok", F.col("_said")).when(F.trim("page_text") == "", NO_TEXT).when(~fine, LITTLE_TEXT).otherwise("ok")).withColumn("ok", F.col("reason") == "ok")
    held = archive.select(F.col("url_key").alias("_of"), F.col("text").alias("_text"), F.col("title").alias("_title"))
    held = held.join(c.where("ok").select(F.col("_key").alias("_of")).distinct(), "_of", "left_semi")
    both = c.join(held, F.col("_key") == F.col("_of"), "left")
    older = F.col("ok") & F.col("_of").isNotNull() & O.shrinks(F.col("_text"), F.col("page_text"), explicit)
    both = both.withColumn("kept_older", F.coalesce(older, no))
    both = both.withColumns({"page_text": F.when(F.col("kept_older"), F.col("_text")).otherwise(F.col("page_text")), "page_title": F.when(F.col("kept_older"), F.col("_title")).otherwise(F.col("page_title")), "last_seen": O.not_before(F.col("captured_at"), now)})
    return both.drop("_said", "_canon", "_key", "_of", "_text", "_title")


def as_pages(judged: DataFrame) -> DataFrame:
    """The kept contents as input of ``upsert``."""
    none = lambda kind: F.lit(None).cast(kind)
    return judged.where("ok").select(F.col("filed").alias("url"), F.col("page_title").alias("title"), F.col("page_text").alias("text"), "last_seen", F.lit(False).alias("pinned"), none("long").alias("first_seen"), none("int").alias("visit_count"), "arrival")


def imports(rows: DataFrame, archive: DataFrame, excluded: Column, now: int) -> DataFrame:
    """Import rows (``schemas.PAGE_INPUT`` and ``arrival``) with ``status`` and ``stored``, whether the row goes into the archive.

    Statuses are failed, excluded, skipped (held, or earlier in this import, at a date
    as late; or unchanged, which still counts a visit) and imported.
    """
    r = rows.withColumns({"url_key": U.url_key(F.col("url")), "text": X.truncated(F.col("text")), "title": F.left(F.coalesce("title", F.lit("")), F.lit(S.TITLE_CHARS)), "last_seen": O.not_before(F.col("last_seen"), now)})
    r = r.withColumns({"first_seen": F.when(F.col("first_seen").isNotNull(), F.least("first_seen", "last_seen")), "visit_count": F.when(F.col("visit_count") > 0, F.col("visit_count")), "pinned": F.coalesce("pinned", F.lit(False))})
    bad = F.col("url_key").isNull() | (F.coalesce("text", F.lit("")) == "")
    r = r.withColumn("_why", F.when(bad, "failed").when(excluded, "excluded")).withColumn("_hash", X.content_hash(X.indexed_text(F.col("title"), F.col("text"))))
    held = archive.select(F.col("url_key").alias("_of"), F.col("last_seen").alias("_held"), F.col("content_hash").alias("_was"))
    r = r.join(held.join(r.where("_why IS NULL").select(F.col("url_key").alias("_of")).distinct(), "_of", "left_semi"), F.col("url_key") == F.col("_of"), "left")
    # without a reason the row waits for those of its page before it; other rows are told apart by a key of their own
    w = Window.partitionBy(F.when(F.col("_why").isNull(), F.col("url_key")), F.when(F.col("_why").isNotNull(), F.col("arrival"))).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest("_held", F.max("last_seen").over(w))
    r = r.withColumn("stored", F.col("_why").isNull() & ~F.coalesce(seen >= F.col("last_seen"), F.lit(False)))
    before = F.max(F.when(F.col("stored"), F.struct("arrival", "_hash"))).over(w)
    same = F.coalesce(before["_hash"], F.col("_was")).eqNullSafe(F.col("_hash"))
    r = r.withColumn("_same", same)
    return r.withColumn("status", F.coalesce("_why", F.when(~F.col("stored") | F.col("_same"), "skipped").otherwise("imported"))).drop("_why", "_hash", "_of", "_held", "_was", "_same")


def measured(before: DataFrame, after: DataFrame) -> DataFrame:
    """An upserted archive with ``word_count`` and ``bytes``; only pages whose content changed, and their buckets, are measured."""
    old = before.select("id", F.col("content_hash").alias("_was"), F.col("bytes").alias("_bytes"), F.col("word_count").alias("_words"))
    both = after.join(old, "id", "left").withColumn("_changed", ~F.col("content_hash").eqNullSafe(F.col("_was")))
    changed = both.where("_changed").select("id")
    touched = changed.select(F.shiftright("id", S.BUCKET_BITS).alias("_bucket")).distinct()
    near = after.withColumn("_bucket", F.shiftright("id", S.BUCKET_BITS)).join(touched, "_bucket", "left_semi").drop("_bucket")
    share = I.index_bytes(I.postings(near)).join(changed, "id", "left_semi")
    own = I.page_bytes("url", "url_key", "title", "domain", "text", "excerpt", "content_hash")
    words = X.count_terms(X.indexed_text(F.col("title"), F.col("text")))
    new = both.join(share, "id", "left").withColumns({
        "bytes": F.when(F.col("_changed"), own + F.coalesce("index_bytes", F.lit(0))).otherwise(F.col("_bytes")).cast("long"),
        "word_count": F.when(F.col("_changed"), words).otherwise(F.col("_words")).cast("int"),
    })
    return new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.ARCHIVE.fields])
