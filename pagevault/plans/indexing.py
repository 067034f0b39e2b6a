"""Scans, index building and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault.functions import text as X
from pagevault.operators import index as I
from pagevault.operators import store as O
from pagevault.plans import corpus as C

BY_TERM = "the", "and", "12", "eraton"


def tokens(s, d):
    return I.tokens(C.archive(s, d)).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"), F.max("pos").cast("long").alias("last_pos"))


def postings_list(s, d):
    p = I.postings(C.archive(s, d)).where(F.col("term").isin(*BY_TERM))
    return p.select("term", "id", "tf", F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"))


def term_df(s, d):
    return I.dictionary(I.postings(C.archive(s, d)))


def corpus_stats(s, d):
    st = I.statistics(I.word_counts(C.sized(s, d)))
    return st.select("docs", "tokens", "bytes", F.round("mean_length", 6).alias("mean_length"))


def word_count(s, d):
    return I.word_counts(C.archive(s, d)).select("id", F.col("word_count").cast("long").alias("word_count"))


def buckets(s, d):
    b = I.buckets(I.postings(C.archive(s, d)))
    return b.select("term", F.col("bucket").cast("long").alias("bucket"), F.size("docs").cast("long").alias("pages"), F.aggregate("docs", F.lit(0).cast("long"), lambda a, x: a + x["tf"]).alias("tf"))


def index_size(s, d):
    return I.index_bytes(I.postings(C.archive(s, d)))


def page_size(s, d):
    return C.sized(s, d).select("id", "bytes")


def index_estimate(s, d):
    p = I.postings(C.archive(s, d))
    return p.groupBy("id").agg(F.sum(25 + 4 * F.size("pos") + 34 + 2 * F.octet_length("term")).cast("long").alias("estimate"))


def recent_list(s, d):
    return O.recent(C.archive(s, d), 20).select("id", "last_seen", "title")


def recent_order(s, d):
    from pyspark.sql import Window

    # the order as a number: a window per day over the days' offsets, not one over the table
    a = C.archive(s, d).select("id", "last_seen", F.floor(F.col("last_seen") / 86_400_000).alias("day"))
    days = a.groupBy("day").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("day").orderBy(F.desc("last_seen"), F.desc("id"))
    return a.join(F.broadcast(before.select("day", "before")), "day").select("id", (F.row_number().over(w) + F.col("before")).alias("place"))


def oldest_slice(s, d):
    return O.oldest(C.archive(s, d), 50, C.NOW - 5 * 86_400_000, True).select("id", "last_seen", "domain")


def oldest_seen(s, d):
    return O.oldest_first_seen(C.archive(s, d))


def page_meta(s, d):
    return C.sized(s, d).select("id", "url", "domain", "first_seen", "last_seen", "bytes", "pinned")


def domain_pages(s, d):
    return C.archive(s, d).where(F.col("domain") == "src3.example").select("id")


def site_pages(s, d):
    return C.pages(s, d).where(O.on_site("www.example.com")).select("page_id", "domain")


def time_range(s, d):
    return C.archive(s, d).where(O.between(C.NOW - 31 * 86_400_000, C.NOW - 29 * 86_400_000)).select("id", "last_seen")


def keyset_page(s, d):
    return O.after(C.archive(s, d), 41, 100).select("id", "title")


def first_page(s, d):
    return O.after(C.archive(s, d), None, 10).select("id", "title")


def multi_get(s, d):
    ids = s.createDataFrame([(i,) for i in (0, 5, 77, 10**12)], "id long")
    return O.many(C.archive(s, d), ids).select("id", "title")


def excerpts(s, d):
    return C.archive(s, d).select("id", X.excerpt(F.col("text")).alias("excerpt"), X.byte_length(F.col("text")).cast("long").alias("size"))


def content_hashes(s, d):
    return C.hashed(C.archive(s, d)).select("id", "content_hash")


def invariants(s, d):
    return I.invariants(C.index(s, d)).select("kind", F.col("n").cast("long").alias("n"))


def deleted_postings(s, d):
    gone = C.archive(s, d).where(F.col("id") % 7 == 3).select("id")
    return I.dictionary(O.unposted(I.postings(C.archive(s, d)), gone))


QUERIES = {f.__name__: f for f in (
    tokens, postings_list, term_df, corpus_stats, word_count, buckets, index_size, page_size, index_estimate, recent_list, recent_order, oldest_slice, oldest_seen, page_meta,
    domain_pages, site_pages, time_range, keyset_page, first_page, multi_get, excerpts, content_hashes, invariants, deleted_postings,
)}

IN = ", ".join(f"'{t}'" for t in BY_TERM)
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)), '^www\\.', '')"
_HASH = "list_reduce(list_prepend({seed}::BIGINT, list_transform(string_split(title || chr(10) || chr(10) || text, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
SQL = {
    "tokens": f"WITH {C.TOKENS} SELECT id, count(*) AS n, count(DISTINCT term) AS terms, max(pos) AS last_pos FROM tk GROUP BY id",
    "postings_list": f"WITH {C.POSTINGS} SELECT term, id, tf, array_to_string(pos, ',') AS pos FROM post WHERE term IN ({IN})",
    "term_df": f"WITH {C.POSTINGS} SELECT term, df FROM dict",
    "corpus_stats": f"WITH {C.SIZED} SELECT (SELECT docs FROM st) AS docs, (SELECT tokens FROM st)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes, round((SELECT tokens / docs FROM st), 6) AS mean_length FROM sized",
    "word_count": f"WITH {C.TOKENS} SELECT a.id, count(tk.term) AS word_count FROM arch a LEFT JOIN tk ON a.id = tk.id GROUP BY a.id",
    "buckets": f"WITH {C.POSTINGS} SELECT term, id >> 8 AS bucket, count(*) AS pages, sum(tf)::BIGINT AS tf FROM post GROUP BY term, id >> 8",
    "index_size": f"WITH {C.SIZED} SELECT id, b AS index_bytes FROM ib",
    "page_size": f"WITH {C.SIZED} SELECT id, bytes FROM sized",
    "index_estimate": f"WITH {C.POSTINGS} SELECT id, sum(25 + 4 * len(pos) + 34 + 2 * strlen(term))::BIGINT AS estimate FROM post GROUP BY id",
    "recent_list": f"WITH {C.ARCHIVE} SELECT id, last_seen, title FROM arch ORDER BY last_seen DESC, id DESC LIMIT 20",
    "recent_order": f"WITH {C.ARCHIVE} SELECT id, row_number() OVER (ORDER BY last_seen DESC, id DESC) AS place FROM arch",
    "oldest_slice": f"WITH {C.ARCHIVE} SELECT id, last_seen, domain FROM arch WHERE last_seen < {C.NOW - 5 * 86_400_000} AND NOT pinned ORDER BY last_seen, id LIMIT 50",
    "oldest_seen": f"WITH {C.ARCHIVE} SELECT min(first_seen) AS first_seen FROM arch",
    "page_meta": f"WITH {C.SIZED} SELECT id, url, domain, first_seen, last_seen, bytes, pinned FROM sized",
    "domain_pages": f"WITH {C.ARCHIVE} SELECT id FROM arch WHERE domain = 'src3.example'",
    "site_pages": f"SELECT page_id, domain FROM (SELECT page_id, {HOST} AS domain FROM pages) WHERE domain = 'example.com' OR domain LIKE '%.example.com'",
    "time_range": f"WITH {C.ARCHIVE} SELECT id, last_seen FROM arch WHERE last_seen >= {C.NOW - 31 * 86_400_000} AND last_seen < {C.NOW - 29 * 86_400_000}",
    "keyset_page": f"WITH {C.ARCHIVE} SELECT id, title FROM arch WHERE id > 41 ORDER BY id LIMIT 100",
    "first_page": f"WITH {C.ARCHIVE} SELECT id, title FROM arch ORDER BY id LIMIT 10",
    "multi_get": f"WITH {C.ARCHIVE} SELECT id, title FROM arch WHERE id IN (0, 5, 77, 1000000000000)",
    "excerpts": f"WITH {C.ARCHIVE} SELECT id, left(text, 400) AS excerpt, strlen(text) AS size FROM arch",
    "content_hashes": f"WITH {C.ARCHIVE}, h AS (SELECT id, {_HASH.format(seed=0x811C9DC5)} AS a, {_HASH.format(seed=0x9E3779B9)} AS b FROM arch) SELECT id, lpad(to_hex(a), 8, '0') || lpad(to_hex(b), 8, '0') AS content_hash FROM h",
    "invariants": "SELECT * FROM (VALUES ('orphan postings', 0::BIGINT), ('bad entries', 0::BIGINT), ('wrong word counts', 0::BIGINT), ('wrong frequencies', 0::BIGINT), ('wrong impacts', 0::BIGINT)) v(kind, n)",
    "deleted_postings": f"WITH {C.POSTINGS} SELECT term, count(*) AS df FROM post WHERE id % 7 <> 3 GROUP BY term",
}
SQL["content_hashes"] = SQL["content_hashes"].replace("to_hex(a)", "lower(to_hex(a))").replace("to_hex(b)", "lower(to_hex(b))")
