"""Addresses, policy, HTML, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault.functions import rules as R
from pagevault.functions import text as X
from pagevault.functions import urls as U
from pagevault.operators import rule_table as T
from pagevault.operators import store as O
from pagevault.plans import corpus as C
from pagevault.sources import exports as E
from pagevault.sources import html as H
from pagevault.sources import readable as Y

RULES = ["example.org", "*.example.net", "blog.*", "example.com/en/*", "m.thther.example.org/de", "https://www.tionsh.example.net/fr/"]


def url_key(s, d):
    return C.table(s, d, "pages").select("page_id", U.url_key(F.col("url")).alias("url_key"))


def url_domain(s, d):
    return C.table(s, d, "pages").select("page_id", U.domain_of(F.col("url")).alias("domain"))


def dedupe_pages(s, d):
    p = C.table(s, d, "pages").select("page_id", "url", U.url_key(F.col("url")).alias("url_key"))
    return p.groupBy("url_key").agg(F.max("page_id").alias("page_id"), F.count("*").alias("visits"))


def canonical_choice(s, d):
    u = C.table(s, d, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("canon"))
    return u.select("page_id", U.canonical_for(F.col("url"), F.col("canon")).alias("filed"), U.canonical_for(F.col("url"), F.lit("https://elsewhere.example/")).alias("kept"))


def rule_match(s, d):
    p = C.table(s, d, "pages")
    return p.select("page_id", *[R.matches(F.col("url"), r).alias(f"r{i}") for i, r in enumerate(RULES)])


def decide_reason(s, d):
    p = C.table(s, d, "pages")
    return p.select("page_id", R.reason(F.col("url"), RULES[:3], password_field=H.sensitive(F.col("html"))).alias("reason"))


def strict_reason(s, d):
    return C.table(s, d, "pages").select("page_id", R.reason(F.col("url"), [], allowlist=["example.com"]).alias("reason"))


def retro_exclusion(s, d):
    p = C.table(s, d, "pages")
    return p.where(R.any_match(F.col("url"), RULES) | R.secret_in_url(F.col("url"))).select("page_id")


def rule_table(s, d):
    """Pages under rules made of the hosts and paths of every seventh page, given as a table."""
    p = C.table(s, d, "pages")
    some = p.where("page_id % 7 = 0").select(F.concat(U.domain_of(F.col("url")), F.when(F.col("page_id") % 2 == 0, "").otherwise("/en/*")).alias("rule"))
    return T.covered(p, T.compiled(some), "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("rules"))


def html_text(s, d):
    return C.pages(s, d).select("page_id", "title", F.length("text").cast("long").alias("chars"), "text")


def readable_text(s, d):
    """Pages whose article is not marked as one."""
    p = C.table(s, d, "pages")
    bare = F.regexp_replace("html", "<(/?)article>", "<$1div>")
    return p.select("page_id", Y.text(bare).alias("text"))


def minimum_text(s, d):
    p = C.pages(s, d)
    return p.select("page_id", O.long_enough(F.col("title"), F.col("text")).alias("fine"))


def shrink_guard(s, d):
    a = C.archive(s, d)
    return a.select("id", O.shrinks(F.col("text"), F.left("text", (F.col("id") * 37 % 1500).cast("int"))).alias("keep_old"))


def read_heuristic(s, d):
    e = C.table(s, d, "events").select("event_id", (F.col("event_id") * 7919 % 20000).alias("ms"), ((F.col("event_id") % 100) / 100).alias("scroll"), (F.col("event_id") * 31 % 900).alias("words"), (F.col("event_id") % 17 == 0).alias("pdf"))
    return e.select("event_id", O.is_read(F.col("ms"), F.col("scroll"), F.col("words"), F.col("pdf")).alias("read"))


def _incoming(s, d):
    a = C.archive(s, d)
    rows = a.select(F.concat(F.lit("https://site.example/"), F.col("id") % 400).alias("url"), "title", F.when(F.col("id") % 3 == 0, F.lit("same words on every visit to this page")).otherwise(F.col("text")).alias("text"), "last_seen", F.lit(False).alias("pinned"), F.lit(None).cast("long").alias("first_seen"), F.lit(None).cast("int").alias("visit_count"), F.col("id").alias("arrival"))
    return rows.withColumn("title", F.lit("t"))


def upsert(s, d):
    from pagevault.schemas import ARCHIVE

    out = O.upsert(s.createDataFrame([], ARCHIVE), _incoming(s, d))
    return out.select("url_key", "visit_count", "first_seen", "last_seen", F.md5("text").alias("text_md5"))


def import_status(s, d):
    a = C.archive(s, d)
    held = a.where(F.col("id") % 2 == 0).select(U.url_key(F.col("url")).alias("url_key"), "last_seen")
    rows = a.select("id", F.when(F.col("id") % 11 == 0, F.lit("ftp://x")).otherwise(F.col("url")).alias("url"), F.when(F.col("id") % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("text"), (F.col("last_seen") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("last_seen"), "first_seen")
    out = O.import_status(rows, held, R.any_match(F.col("url"), ["src7.example"]), C.NOW)
    return out.groupBy("status").agg(F.count("*").alias("n"))


def export_rows(s, d):
    r = E.rows(C.archive(s, d))
    return r.select("url", "firstSeen", "lastSeen", F.col("visitCount").cast("long").alias("visitCount"), "pinned")


def set_operations(s, d):
    a = C.archive(s, d)
    x, y = a.where("id % 2 = 0").select("domain", F.col("id") % 10).distinct(), a.where("id % 3 = 0").select("domain", F.col("id") % 10).distinct()
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
    return n(x.intersect(y), "intersect").unionByName(n(x.union(y).distinct(), "union")).unionByName(n(x.exceptAll(y), "except"))


QUERIES = {f.__name__: f for f in (
    url_key, url_domain, dedupe_pages, canonical_choice, rule_match, decide_reason, strict_reason, retro_exclusion, rule_table, html_text, readable_text, minimum_text, shrink_guard,
    read_heuristic, upsert, import_status, export_rows, set_operations,
)}

_PARTS = """u AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS sch, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\\.', '') AS host,
 CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1) END AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
 k AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) AS kept FROM u),
 keys AS (SELECT *, sch || '://' || host || CASE WHEN length(path) > 1 AND ends_with(path, '/') THEN left(path, length(path) - 1) ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM k)"""
_R = [
    "host = 'example.org' OR ends_with(host, '.example.org')", "ends_with(host, '.example.net')", "starts_with(host, 'blog.')", "(host = 'example.com' OR ends_with(host, '.example.com')) AND (starts_with(lower(path), '/en/') OR lower(path) = '/en')",
    "(host = 'm.thther.example.org' OR ends_with(host, '.m.thther.example.org')) AND lower(path) IN ('/de', '/de/')", "(host = 'tionsh.example.net' OR ends_with(host, '.tionsh.example.net')) AND (starts_with(lower(path), '/fr/') OR lower(path) = '/fr')",
]
_TEXT = """regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1), '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', '', 'g'), '(?i)<br\\s*/?>|</?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|blockquote|pre)\\b[^>]*>', chr(10), 'g')"""
_PLAIN = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_PAGE = f"""hp AS (SELECT page_id, trim({_PLAIN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
 trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN(f"regexp_replace({_TEXT}, '<[^>]*>', '', 'g')")}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages)"""
SQL = {
    "url_key": f"WITH {_PARTS} SELECT page_id, url_key FROM keys",
    "url_domain": f"WITH {_PARTS} SELECT page_id, host AS domain FROM u",
    "dedupe_pages": f"WITH {_PARTS} SELECT url_key, max(page_id) AS page_id, count(*) AS visits FROM keys GROUP BY url_key",
    "canonical_choice": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS filed, url AS kept FROM pages",
    "rule_match": f"WITH {_PARTS} SELECT page_id, {', '.join(f'({c}) AS r{i}' for i, c in enumerate(_R))} FROM u",
    "decide_reason": f"WITH {_PARTS} SELECT page_id, CASE WHEN {' OR '.join(f'({c})' for c in _R[:3])} THEN 'excluded: ' || host ELSE 'ok' END AS reason FROM u",
    "strict_reason": f"WITH {_PARTS} SELECT page_id, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'ok' ELSE 'not on your allowlist' END AS reason FROM u",
    "retro_exclusion": f"WITH {_PARTS} SELECT page_id FROM u WHERE {' OR '.join(f'({c})' for c in _R)}",
    "rule_table": f"""WITH {_PARTS}, r AS (SELECT DISTINCT host AS h, page_id % 2 = 1 AS en FROM u WHERE page_id % 7 = 0)
 SELECT page_id, count(*) AS rules FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND (NOT en OR lower(path) = '/en' OR starts_with(lower(path), '/en/')) GROUP BY page_id""",
    "html_text": f"WITH {_PAGE} SELECT page_id, title, length(text) AS chars, text FROM hp",
    "readable_text": f"WITH {_PAGE} SELECT page_id, text FROM hp",
    "minimum_text": f"WITH {_PAGE} SELECT page_id, length(trim(text)) >= 25 AND length(trim(text)) >= length(title) + 20 AS fine FROM hp",
    "shrink_guard": f"WITH {C.ARCHIVE}, x AS (SELECT id, length(trim(text)) AS a, length(trim(left(text, (id * 37 % 1500)::INT))) AS b FROM arch) SELECT id, a >= 1000 AND b < a * 0.4 AS keep_old FROM x",
    "read_heuristic": "WITH e AS (SELECT event_id, event_id * 7919 % 20000 AS ms, (event_id % 100) / 100.0 AS scroll, event_id * 31 % 900 AS words, event_id % 17 = 0 AS pdf FROM events) SELECT event_id, ms >= 9000 AND (pdf OR (words > 0 AND words <= 400) OR scroll >= 0.35) AS read FROM e",
    "upsert": f"""WITH {C.ARCHIVE}, r AS (SELECT 'https://site.example/' || (id % 400) AS url_key, id, last_seen, CASE WHEN id % 3 = 0 THEN 'same words on every visit to this page' ELSE text END AS text FROM arch)
 SELECT url_key, count(*)::INT AS visit_count, arg_min(last_seen, id) AS first_seen, max(last_seen) AS last_seen, md5(arg_max(text, id)) AS text_md5 FROM r GROUP BY url_key""",
    "import_status": f"""WITH {C.ARCHIVE}, r AS (SELECT id, CASE WHEN id % 11 = 0 OR id % 13 = 0 OR text = '' THEN 'failed' WHEN domain = 'src7.example' THEN 'excluded' WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'skipped' ELSE 'imported' END AS status FROM arch) SELECT status, count(*) AS n FROM r GROUP BY status""",
    "export_rows": f"WITH {C.ARCHIVE} SELECT url, strftime(make_timestamp(first_seen * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"firstSeen\", strftime(make_timestamp(last_seen * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"lastSeen\", visit_count::BIGINT AS \"visitCount\", pinned FROM arch",
    "set_operations": f"""WITH {C.ARCHIVE}, x AS (SELECT DISTINCT domain, id % 10 AS m FROM arch WHERE id % 2 = 0), y AS (SELECT DISTINCT domain, id % 10 AS m FROM arch WHERE id % 3 = 0)
 SELECT 'intersect' AS op, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS n UNION ALL SELECT 'union', (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)) UNION ALL SELECT 'except', (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y))""",
}
