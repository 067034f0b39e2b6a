"""The test tables seen as an archive, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.functions import text as X
from pagevault.functions import urls as U
from pagevault.operators.index import Index, index_bytes, page_bytes, postings
from pagevault.operators.scratch import temporary
from pagevault.sources import html as H

NOW = 1_706_745_600_000  # 2024-02-01 00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, last seen when the event of the same number happened."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events").select("event_id", "ts")
    a = d.join(e, F.col("doc_id") == F.col("event_id")).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias("url"), F.left("text", F.lit(80)).alias("title"), "text",
        F.concat("source", F.lit(".example")).alias("domain"), F.unix_millis(F.col("ts").cast("timestamp")).alias("last_seen"), (F.unix_millis(F.col("ts").cast("timestamp")) - 86_400_000 * (F.col("doc_id") % 30)).alias("first_seen"),
        (F.col("doc_id") % 50 == 0).alias("pinned"), (1 + F.col("doc_id") % 3).cast("int").alias("visit_count"),
    )
    return a


ARCHIVE = """arch AS (SELECT d.doc_id AS id, 'https://' || d.source || '.example/' || d.doc_id AS url, left(d.text, 80) AS title, d.text, d.source || '.example' AS domain,
 (epoch_us(e.ts) // 1000) AS last_seen, (epoch_us(e.ts) // 1000) - 86400000 * (d.doc_id % 30) AS first_seen, d.doc_id % 50 = 0 AS pinned, (1 + d.doc_id % 3)::INT AS visit_count
 FROM documents d JOIN events e ON e.event_id = d.doc_id)"""
FOLD = "replace(lower(strip_accents({x})), 'ß', 'ss')"
WORDS = "list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), lambda w: " + FOLD.format(x="w") + ")"
TOKENS = (
    ARCHIVE
    + ", wl AS (SELECT id, "
    + WORDS.format(x="title || chr(10) || chr(10) || text")
    + " AS ws FROM arch), tok AS (SELECT id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS term FROM wl), tk AS (SELECT * FROM tok WHERE term <> '' AND length(term) <= 64)"
)
POSTINGS = TOKENS + ", post AS (SELECT term, id, count(*)::INT AS tf, list(pos ORDER BY pos)[1:32] AS pos FROM tk GROUP BY term, id), dict AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT (SELECT count(*) FROM arch) AS docs, (SELECT sum(tf) FROM post) AS tokens)"
ALL_POSITIONS = POSTINGS.replace("[1:32]", "")
PAGE_BYTES = "(strlen(url) + strlen(url_key) + strlen(title) + strlen(domain) + strlen(text) + strlen(excerpt) + strlen(content_hash) + 130)"


_BUILT: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The saved index of a corpus: built once in an application, then read, sorted by term, by every search.

    It is kept in ``spark.checkpoint.dir`` (a folder all executors share) and removed when the driver ends.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = temporary(spark, "index")
        Index.of(archive(spark, sf_dir)).save(path)
        _BUILT[key] = path
    return Index.load(spark, _BUILT[key])


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive with ``bytes``: the text, title and address, and the page's share of the index."""
    a = archive(spark, sf_dir)
    b = index_bytes(postings(a))
    return a.join(b, "id", "left").withColumn("bytes", (page_bytes("url", "title", "domain", "text") + F.coalesce("index_bytes", F.lit(0))).cast("long")).drop("index_bytes")


SIZED = (
    POSTINGS
    + """, ib AS (SELECT id, sum(25 + 4 * len(pos) + CASE WHEN rn = 1 THEN 34 + 2 * strlen(term) ELSE 0 END)::BIGINT AS b
 FROM (SELECT *, row_number() OVER (PARTITION BY term, id >> 8 ORDER BY id) AS rn FROM post) GROUP BY id),
 sized AS (SELECT a.*, (strlen(url) + strlen(title) + strlen(domain) + strlen(text) + 130 + coalesce(ib.b, 0))::BIGINT AS bytes FROM arch a LEFT JOIN ib ON a.id = ib.id)"""
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", U.url_key(F.col("url")).alias("url_key"), U.domain_of(F.col("url")).alias("domain"), H.title(F.col("html")).alias("title"), H.text(F.col("html")).alias("text"))


def hashed(a: DataFrame) -> DataFrame:
    return a.withColumn("content_hash", X.content_hash(X.indexed_text(F.col("title"), F.col("text"))))
