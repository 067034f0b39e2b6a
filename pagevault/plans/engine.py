"""What the engine composes, over whole tables: imports, captures, sweeps, deletions and exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault.functions import rules as R
from pagevault.functions import urls as U
from pagevault.operators import capture as A
from pagevault.operators import retention as K
from pagevault.operators import search as Q
from pagevault.operators import store as O
from pagevault.operators.engine import Engine
from pagevault.operators.scratch import settle, temporary
from pagevault.plans import corpus as C
from pagevault.plans import pages as PG
from pagevault.plans import retrieval as G
from pagevault.plans.budget import CAP, _plan_sql
from pagevault.schemas import ARCHIVE
from pagevault.streaming import ingest as T

MONTHS = 0.99
RULES = ["src7.example"]


def _held(s, rows):
    """An archive of rows (``schemas.PAGE_INPUT`` and an arrival number)."""
    empty = s.createDataFrame([], ARCHIVE)
    return settle(A.measured(empty, settle(O.upsert(empty, rows), "held")), "held")


def _engine(s, pages) -> Engine:
    """An engine in a folder of its own that holds the pages."""
    e = Engine(s, temporary(s, "engine"), clock=lambda: C.NOW)
    e.set_settings({"setup_complete": True, "custom_rules": PG.RULES[:3]})
    e.restore(pages)
    return e


def _input(a, arrival="id"):
    none = lambda kind: F.lit(None).cast(kind)
    return a.select("url", "title", "text", "last_seen", F.lit(False).alias("pinned"), none("long").alias("first_seen"), none("int").alias("visit_count"), F.col(arrival).alias("arrival"))


def key_scan(s, d):
    return O.keys(C.pages(s, d).withColumnRenamed("page_id", "id"))


def unique_lookup(s, d):
    a = C.archive(s, d).withColumn("url_key", U.url_key(F.col("url")))
    found = [O.by_url(a, u) for u in ("https://src3.example/13?utm_source=x#top", "HTTPS://WWW.src1.example/1", "ftp://src1.example/1", "https://none.example/")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).select("id", "url_key")


def log_read(s, d):
    e = C.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 997 * 1000).alias("at"), "event_type")
    return K.read_log(e)


def upsert_held(s, d):
    rows = PG._incoming(s, d)
    first = settle(O.upsert(s.createDataFrame([], ARCHIVE), rows.where("arrival % 2 = 0")), "first")
    out = O.upsert(first, rows.where("arrival % 2 = 1"))
    return out.select("url_key", "visit_count", "first_seen", "last_seen", F.md5("text").alias("text_md5"))


def new_ids(s, d):
    out = O.upsert(s.createDataFrame([], ARCHIVE), PG._incoming(s, d))
    return out.select("id", "url_key")


def import_pages(s, d):
    a = C.archive(s, d)
    held = _held(s, _input(a.where("id % 2 = 0")))
    rows = _input(a).withColumns({
        "url": F.when(F.col("arrival") % 11 == 0, F.lit("ftp://x")).otherwise(F.col("url")), "text": F.when(F.col("arrival") % 13 == 0, F.lit("")).when(F.col("arrival") % 8 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text")),
        "last_seen": F.col("last_seen") + F.when(F.col("arrival") % 4 == 0, 1).otherwise(0), "visit_count": F.when(F.col("arrival") % 5 == 0, F.lit(9)),
    })
    judged = settle(A.imports(rows, held, R.any_match(F.col("url"), RULES), C.NOW), "judged")
    out = O.upsert(held, judged.where("stored").select(*A.PAGE, "arrival"))
    tally = judged.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    kept = out.groupBy("visit_count").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("pages with visits "), "visit_count").alias("status"), "n")
    return tally.unionByName(kept)


def capture_outcomes(s, d):
    a = C.archive(s, d)
    held = _held(s, _input(a.where("id % 3 = 0")))
    cut = F.left("text", (F.col("id") * 37 % 1500).cast("int"))
    rows = a.select(F.col("id").alias("arrival"), F.concat("url", F.lit("?utm_source=x")).alias("url"), "url", "title", cut.alias("text"), (F.col("last_seen") + 10**12 * (F.col("id") % 2)).alias("captured_at"), (F.col("id") % 17 == 0).alias("has_password_field"), (F.col("id") % 5 == 0).alias("explicit"))
    rows = rows.toDF("arrival", "url", "canonical", "title", "text", "captured_at", "has_password_field", "explicit")
    out = A.contents(rows, held, {"rules": RULES}, C.NOW)
    return out.select("arrival", "reason", "kept_older", "filed", "last_seen")


def offered(s, d):
    e = C.table(s, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("https://u"), F.col("user_id") % 9, F.lit(".example/")).alias("url"), (F.col("event_id") % 19 == 0).alias("has_password_field"), (F.col("event_id") * 7919 % 20000).alias("focused_ms"), ((F.col("event_id") % 100) / 100).alias("scroll_depth"), (F.col("event_id") * 31 % 900).alias("word_count"), F.lit(False).alias("is_pdf"))
    return A.offers(rows, {"rules": ["u3.example"]}).select("id", "capture", "reason")


def sweep(s, d):
    a = settle(C.sized(s, d), "sized")
    plan = settle(K.plan(a, C.NOW, MONTHS, CAP), "plan")
    left = O.without(a, plan).agg(F.count(F.lit(1)).alias("pages_left"), F.sum("bytes").cast("long").alias("bytes_left"))
    return K.summary(plan).crossJoin(F.broadcast(left)).select("bytes_freed", "age", "size", "reason", "pages_left", "bytes_left")  # one row each


def deleted_in_batches(s, d):
    a = C.sized(s, d)
    ids = a.where("id % 5 = 2").select("id").unionByName(s.createDataFrame([(-1,)], "id long"))
    n = O.deletion(a, ids)
    left = O.removed(a, ids, 3)[-1].agg(F.count(F.lit(1))).scalar()
    return n.select("deleted", "bytes_freed", left.cast("int").alias("pages_left"))


def forget_site(s, d):
    e = _engine(s, C.sized(s, d))
    e.forget("site", "www.src4.example")
    return e.archive().select("id")


def block_site(s, d):
    e = _engine(s, C.sized(s, d))
    e.block_site("src4.example")
    return e.archive().groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def wiped(s, d):
    e = _engine(s, C.sized(s, d))
    e.wipe()
    return e.log().select(e.archive().agg(F.count(F.lit(1))).scalar().alias("pages_left"), F.col("count").cast("int").alias("deleted"))


def excluded_removed(s, d):
    p = C.table(s, d, "pages").withColumnRenamed("page_id", "id")
    gone = p.where(R.any_match(F.col("url"), PG.RULES) | R.secret_in_url(F.col("url"))).select("id")
    return O.without(p, gone).select("id")


def page_statuses(s, d):
    p = C.table(s, d, "pages").select("page_id", "url", U.url_key(F.col("url")).alias("url_key"))
    held = p.where("page_id % 2 = 0").groupBy("url_key").agg(F.max("page_id").alias("id"), F.max_by("url", "page_id").alias("url"))
    held = held.select("id", "url", F.lit("t").alias("title"), F.lit("x").alias("text"), F.lit(1).alias("last_seen"), F.lit(1).alias("first_seen"), F.lit(1).alias("visit_count"), F.lit(False).alias("pinned"))
    return _engine(s, held).page_statuses(p.select("page_id", "url")).select("page_id", F.col("kept.id").alias("kept"), "reason")


def more_pages(s, d):
    shape = G.SHAPES["paging"]
    page = Q.search(C.index(s, d), G.queries_of(shape), C.NOW, shape["limit"], shape["offset"])
    return page.select("query", "total", "has_more").distinct()


def reciprocal_rank(s, d):
    shape = G.SHAPES["batch_search"]
    page = Q.search(C.index(s, d), G.queries_of(shape), C.NOW, shape["limit"])
    known = page.groupBy("query").agg(F.max("id").alias("id"))
    return Q.quality(page, known).select(F.round("mrr", 6).alias("mrr"), F.round("top3", 6).alias("top3"), "queries")


def greatest_values(s, d):
    return T.most(C.table(s, d, "events"))


QUERIES = {f.__name__: f for f in (
    key_scan, unique_lookup, log_read, upsert_held, new_ids, import_pages, capture_outcomes, offered, sweep, deleted_in_batches, forget_site, block_site, wiped, excluded_removed, page_statuses, more_pages, reciprocal_rank, greatest_values,
)}

_IN = """r AS (SELECT 'https://site.example/' || (id % 400) AS url_key, id, last_seen, CASE WHEN id % 3 = 0 THEN 'same words on every visit to this page' ELSE text END AS text FROM arch)"""
_BATCH = G.SQL["batch_search"]
_CUT = "left(text, (id * 37 % 1500)::INT)"
SQL = {
    "key_scan": f"WITH {PG._PARTS} SELECT page_id AS id, url_key FROM keys",
    "unique_lookup": f"WITH {C.ARCHIVE} SELECT id, url AS url_key FROM arch WHERE url IN ('https://src3.example/13', 'https://src1.example/1')",
    "log_read": "SELECT event_id AS id, event_id % 997 * 1000 AS \"at\", event_type FROM events ORDER BY 2 DESC, 1 DESC LIMIT 20",
    "upsert_held": f"""WITH {C.ARCHIVE}, {_IN}, o AS (SELECT *, (id % 2) * 1000000000 + id AS n FROM r)
 SELECT url_key, count(*)::INT AS visit_count, arg_min(last_seen, n) AS first_seen, max(last_seen) AS last_seen, md5(arg_max(text, n)) AS text_md5 FROM o GROUP BY url_key""",
    "new_ids": f"WITH {C.ARCHIVE}, {_IN} SELECT row_number() OVER (ORDER BY min(id)) AS id, url_key FROM r GROUP BY url_key",
    "import_pages": f"""WITH {C.ARCHIVE}, x AS (SELECT *, CASE WHEN id % 11 = 0 OR id % 13 = 0 OR text = '' THEN 'failed' WHEN domain = 'src7.example' THEN 'excluded' WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'skipped' WHEN id % 4 = 0 AND id % 8 <> 0 THEN 'unchanged' ELSE 'imported' END AS status FROM arch),
 y AS (SELECT *, status IN ('imported', 'unchanged') AS stored FROM x),
 v AS (SELECT CASE WHEN NOT stored THEN 1 WHEN id % 2 = 0 THEN CASE WHEN status = 'imported' AND id % 5 = 0 THEN 9 ELSE 2 END ELSE CASE WHEN id % 5 = 0 THEN 9 ELSE 1 END END AS visits FROM y WHERE stored OR id % 2 = 0)
 SELECT replace(status, 'unchanged', 'skipped') AS status, count(*) AS n FROM y GROUP BY 1 UNION ALL SELECT 'pages with visits ' || visits, count(*) FROM v GROUP BY 1""",
    "capture_outcomes": f"""WITH {C.ARCHIVE}, x AS (SELECT *, {_CUT} AS cut FROM arch), z AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'a password or payment field on the page' WHEN domain = 'src7.example' THEN 'excluded: src7.example' WHEN trim(cut) = '' THEN 'nothing to index'
   WHEN id % 5 <> 0 AND (length(trim(cut)) < 25 OR length(trim(cut)) < length(title) + 20) THEN 'too little text to be worth finding later' ELSE 'ok' END AS reason FROM x)
 SELECT id AS arrival, reason, reason = 'ok' AND id % 3 = 0 AND id % 5 <> 0 AND length(trim(text)) >= 1000 AND length(trim(cut)) < length(trim(text)) * 0.4 AS kept_older, CASE WHEN domain = 'src7.example' THEN url || '?utm_source=x' ELSE url END AS filed, least(last_seen + 1000000000000 * (id % 2), {C.NOW}) AS last_seen FROM z""",
    "offered": """WITH e AS (SELECT event_id AS id, user_id % 9 AS u, event_id % 19 = 0 AS pw, event_id * 7919 % 20000 AS ms, (event_id % 100) / 100.0 AS scroll, event_id * 31 % 900 AS words FROM events),
 r AS (SELECT id, CASE WHEN pw THEN 'a password or payment field on the page' WHEN u = 3 THEN 'excluded: u3.example' WHEN ms >= 9000 AND ((words > 0 AND words <= 400) OR scroll >= 0.35) THEN 'read' ELSE 'still reading' END AS reason FROM e)
 SELECT id, reason = 'read' AS capture, reason FROM r""",
    "sweep": f"""WITH {_plan_sql("eviction_both")}, l AS (SELECT count(*) AS pages_left, sum(bytes)::BIGINT AS bytes_left FROM sized WHERE id NOT IN (SELECT id FROM plan))
 SELECT sum(bytes)::BIGINT AS bytes_freed, count(*) FILTER (WHERE reason = 'age') AS age, count(*) FILTER (WHERE reason = 'size') AS size, CASE WHEN count(DISTINCT reason) = 2 THEN 'both' ELSE min(reason) END AS reason, any_value(pages_left) AS pages_left, any_value(bytes_left) AS bytes_left FROM plan, l""",
    "deleted_in_batches": f"WITH {C.SIZED} SELECT count(*) FILTER (WHERE id % 5 = 2) AS deleted, sum(bytes) FILTER (WHERE id % 5 = 2)::BIGINT AS bytes_freed, count(*) FILTER (WHERE id % 5 <> 2)::INT AS pages_left FROM sized",
    "forget_site": f"WITH {C.ARCHIVE} SELECT id FROM arch WHERE domain <> 'src4.example'",
    "wiped": f"WITH {C.ARCHIVE} SELECT 0::BIGINT AS pages_left, count(*)::INT AS deleted FROM arch",
    "excluded_removed": f"WITH {PG._PARTS} SELECT page_id AS id FROM u WHERE NOT ({' OR '.join(f'({c})' for c in PG._R)})",
    "page_statuses": f"""WITH {PG._PARTS}, h AS (SELECT url_key, max(page_id) AS held FROM keys WHERE page_id % 2 = 0 GROUP BY url_key)
 SELECT page_id, h.held AS kept, CASE WHEN {" OR ".join(f"({c})" for c in PG._R[:3])} THEN 'excluded: ' || host ELSE 'ok' END AS reason FROM keys LEFT JOIN h USING (url_key)""",
    "more_pages": f"SELECT DISTINCT query, total, 40 < total AS has_more FROM ({G.SQL['paging']})",
    "reciprocal_rank": f"WITH b AS ({_BATCH}), k AS (SELECT query, max(id) AS id FROM b GROUP BY query) SELECT round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, count(*) AS queries FROM k JOIN b USING (query, id)",
    "greatest_values": """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f) SELECT user_id, session::BIGINT AS session, event_type, max(value) AS most FROM g GROUP BY user_id, session, event_type""",
}
