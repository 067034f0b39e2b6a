"""Functions of single values, each over a whole table, with SQL that computes the same."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

from pagevault.functions import passages as P
from pagevault.functions import query as G
from pagevault.functions import rules as R
from pagevault.functions import text as X
from pagevault.functions.stem import default_languages
from pagevault.operators import index as I
from pagevault.operators import retention as K
from pagevault.operators import store as O
from pagevault.operators import summary as M
from pagevault.operators.stemming import stem_udf
from pagevault.plans import corpus as C
from pagevault.settings import normalised
from pagevault.sources import html as H

DAY = 86_400_000


def _each(f: Callable, schema: str):
    """A plain function of values as a column function over Arrow batches."""

    @F.arrow_udf(schema)
    def run(*columns: pa.Array) -> pa.Array:
        kind = pa.struct([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")]) if " " in schema else {"long": pa.int64(), "string": pa.string()}[schema]
        rows = [f(*x) for x in zip(*(c.to_pylist() for c in columns), strict=True)]
        return pa.array([dict(zip(kind.names, r, strict=True)) for r in rows] if " " in schema else rows, type=kind)

    return run


def stems(s, d):
    """Every word of the documents in a declared language, and its stem."""
    words = C.table(s, d, "documents").select("lang", F.explode(X.terms(F.col("text"))).alias("word")).where("word IS NOT NULL").distinct()
    return words.select("word", "lang", stem_udf("word", "lang").alias("stem"))


def stem_expand(s, d):
    """Stems of the dictionary and how many words share them."""
    by = I.dictionary(I.postings(C.archive(s, d))).select("term", "df", stem_udf("term", F.lit("en")).alias("stem"))
    return by.groupBy("stem").agg(F.count(F.lit(1)).alias("words"), F.sum("df").alias("pages"))


def stem_languages(s, d):
    known = _each(lambda tags: ",".join(default_languages(tags or [])), "string")
    by = C.table(s, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set(F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "-XX").otherwise("")))).alias("tags"))
    return by.select("source", known("tags").alias("languages"))


def quote_vectors(s, d):
    """Quotes that stand as they were, stand in other cases and spaces, or are gone."""
    a = C.archive(s, d).select("id", "text", F.regexp_extract("text", r"^\S+ \S+ \S+", 0).alias("first"))
    quote = F.when(F.col("id") % 3 == 0, F.substring("text", 101, 60)).when(F.col("id") % 3 == 1, F.upper(F.replace("first", F.lit(" "), F.lit("  ")))).otherwise("zzq kangaroos in zzq")
    at = a.where("length(text) > 200 AND first != '' AND first = regexp_replace(first, '[^ -~]', '') AND upper(first) != first").select("id", P.locate_udf(F.col("text"), quote).alias("at"))
    return at.select("id", "at.start", "at.end", "at.how")


def snippet_vectors(s, d):
    """The densest passage of each page for two words of its own, with its marks; the opening of each fifth page, searched for a word that it lacks."""
    a = C.archive(s, d).withColumn("words", F.array_compact(X.terms(F.col("text"))))
    word = lambda share: F.get("words", F.floor(F.size("words") * share / 3).cast("int"))
    wanted = F.when((F.col("id") % 5 == 4) | (F.size("words") == 0), F.array(F.lit("zzqnothing"))).otherwise(F.array(word(1), word(2)))
    shown = a.select("id", P.snippet_udf("text", wanted).alias("s"))
    marks = F.array_join(F.transform("s.ranges", lambda r: F.array_join(r.cast("array<string>"), "-")), ",")
    return shown.select("id", F.col("s.text").alias("text"), F.size("s.ranges").cast("long").alias("marks"), marks.alias("ranges"))


def phrase_vectors(s, d):
    shown = C.archive(s, d).select("id", F.left("text", F.lit(200)).alias("shown"))
    return shown.select("id", P.phrase_udf("shown", F.array().cast("array<array<int>>")).alias("phrase"))


def marked_vectors(s, d):
    mark = _each(lambda t, n: P.marked(t, [(0, n)]), "string")
    a = C.archive(s, d).select("id", "title", F.length(F.regexp_extract("title", r"^\S*", 0)).cast("long").alias("n"))
    return a.select("id", mark("title", "n").alias("html"))


def rule_normalised(s, d):
    """Addresses of pages as rules."""
    return C.table(s, d, "pages").select("page_id", _each(R.normalise, "string")("url").alias("rule"))


def _dates(events):
    """What people type as dates, made of the events' own."""
    ts = F.col("ts").cast("timestamp")
    said = F.when(F.col("event_id") % 5 == 0, F.date_format(ts, "yyyy")).when(F.col("event_id") % 5 == 1, F.date_format(ts, "yyyy-MM-dd")).when(F.col("event_id") % 5 == 2, (F.col("event_id") % 900).cast("string"))
    return said.when(F.col("event_id") % 5 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(F.col("event_type"))


def when_parsed(s, d):
    e = C.table(s, d, "events")
    return e.select("event_id", _each(lambda x: G.parse_when(x, C.NOW), "long")(_dates(e)).alias("ms"))


def query_parsed(s, d):
    def parse(text):
        q = G.parse(text, C.NOW)
        return ",".join(q.terms), "|".join(" ".join(p) for p in q.phrases), ",".join(q.exclude), q.site, q.after

    w = lambda i: F.regexp_extract("text", r"^\s*" + r"\S+\s+" * i + r"(\p{L}+)", 1)
    d_ = C.table(s, d, "documents").select("doc_id", F.concat(F.lit('"'), w(0), F.lit(" "), w(1), F.lit('" '), w(2), F.lit(" -"), w(3), F.lit(" site:www."), F.col("source"), F.lit(".example/x after:2024-01-"), F.lpad(((F.col("doc_id") % 28) + 1).cast("string"), 2, "0")).alias("typed"))
    q = d_.select("doc_id", "typed", _each(parse, "terms string, phrases string, excluded string, site string, after long")("typed").alias("q"))
    return q.select("doc_id", F.col("q.phrases") != "", F.col("q.terms").alias("terms"), F.col("q.site").alias("site"), F.col("q.after").alias("after")).toDF("doc_id", "phrase", "terms", "site", "after")


def utf8_cuts(s, d):
    return C.table(s, d, "documents").select("doc_id", X.truncated(F.col("text"), 101).alias("cut"))


def clock_holds(s, d):
    e = C.table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now"))
    e = e.select("event_id", "now", (F.col("now") - (F.col("event_id") % 13 - 1) * DAY).alias("last"), (F.col("now") + (F.col("event_id") % 5 - 1) * 36_000_000).alias("until"))
    return e.select("event_id", _each(K.clock_hold, "problem string, until long")("now", "last", "until").alias("h")).select("event_id", "h.problem", "h.until")


def settings_checked(s, d):
    def checked(text):
        x = normalised(json.loads(text))
        return float(x.retention_months), float(x.size_cap_bytes), x.mode

    e = C.table(s, d, "events").select("event_id", "value", F.when(F.col("event_id") % 2 == 0, "strict").otherwise(F.col("event_type")).alias("mode"))
    raw = F.to_json(F.struct(F.col("value").alias("retention_months"), (F.col("event_id") * 1000 - 5000).cast("string").alias("size_cap_bytes"), "mode"))
    return e.select("event_id", _each(checked, "months double, cap double, mode string")(raw).alias("x")).select("event_id", "x.months", "x.cap", "x.mode")


def size_words(s, d):
    a = C.table(s, d, "documents").select("doc_id", (F.col("doc_id") * F.col("doc_id") * 12_345).alias("b"))
    return a.select("doc_id", X.pages_for(F.col("b")).alias("pages"), X.describe_size(F.col("b")).alias("size"))


def pdf_magic(s, d):
    a = C.table(s, d, "documents")
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7\n").when(F.col("doc_id") % 3 == 1, " %PDF-").otherwise(""), F.col("text"))
    return a.select("doc_id", O.is_pdf(F.encode(content, "UTF-8")).alias("pdf"))


def _linked(p):
    """Pages with a canonical link put in, of every page but each fourth."""
    link = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit('<link rel="stylesheet" href="/s"><link href="'), F.col("url"), F.lit("\" rel='canonical'><link rel=canonical href=/two>")))
    return F.replace("html", F.lit("<title>"), F.concat(link, F.lit("<title>")))


def canonical_links(s, d):
    p = C.table(s, d, "pages")
    return p.select("page_id", H.canonical(_linked(p)).alias("link"))


FIELDS = ('<input type="password">', '<INPUT autocomplete="cc-number">', "<input type=text name=q>", '<iframe src="https://checkout.stripe.com/c">', '<iframe src="https://js.stripe.com/v3/metrics-1">', "")
ASKS = (True, True, False, True, False, False)


def sensitive_fields(s, d):
    p = C.table(s, d, "pages")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("page_id") % len(FIELDS) + 1).cast("int"))
    return p.select("page_id", H.sensitive(F.concat("html", field)).alias("sensitive"))


def secret_url(s, d):
    """Addresses of pages with a parameter that is a key, looks like one, or is none."""
    p = C.table(s, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"), F.md5("url").alias("h"))
    more = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("?token="), "h")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("?pageToken="), "h")).when(F.col("page_id") % 4 == 2, "?sort_key=date").otherwise(F.concat(F.lit("#access_token="), "h"))
    return p.select("page_id", R.secret_in_url(F.concat("u", more)).alias("secret"))


def private_host(s, d):
    """Addresses of hosts made of the events' numbers."""
    n = lambda k, m: ((F.col("event_id") * k) % m).cast("string")
    first = F.element_at(F.array(*map(F.lit, ("10", "127", "172", "192", "169", "100", "8", "0"))), (F.col("event_id") % 8 + 1).cast("int"))
    host = F.concat_ws(".", first, F.when(F.col("event_id") % 8 == 3, "168").when(F.col("event_id") % 8 == 4, "254").otherwise(n(37, 256)), n(11, 256), n(7, 256))
    return C.table(s, d, "events").select("event_id", R.private_host(host).alias("private"))


def archive_levels(s, d):
    return M.overview(C.archive(s, d)).select("site", "domain", "day", F.col("level").cast("long").alias("level"), "pages", "pinned", "oldest", "newest")


def archive_cube(s, d):
    return M.overview(C.archive(s, d), cube=True).select("site", "domain", "day", F.col("level").cast("long").alias("level"), "pages")


def last_before(s, d):
    """For every view of a user the last other event at or before it."""
    e = C.table(s, d, "events").withColumn("ms", F.unix_micros(F.col("ts").cast("timestamp")))
    found = M.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ms"), e.where("event_type != 'view'").select("user_id", "ms", F.col("event_id").alias("event"), "value"), "user_id", "ms", ["event", "value"], span=1000 * 3_600_000)
    return found.select("event_id", "last_event", "last_value")


QUERIES = {f.__name__: f for f in (
    stems, stem_expand, stem_languages, quote_vectors, snippet_vectors, phrase_vectors, marked_vectors, rule_normalised, when_parsed, query_parsed, utf8_cuts, clock_holds, settings_checked, size_words, pdf_magic, canonical_links,
    sensitive_fields, secret_url, private_host, archive_levels, archive_cube, last_before,
)}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_LEVEL = f"SELECT coalesce(nullif(regexp_extract(domain, '[^.]+\\.[^.]+$'), ''), domain) AS site, domain, last_seen // {DAY} AS day, last_seen, pinned FROM arch"
SQL = {
    "stem_languages": "WITH t AS (SELECT source, list_sort(list(DISTINCT lang || CASE WHEN doc_id % 2 = 0 THEN '-XX' ELSE '' END)) AS tags FROM documents GROUP BY source), b AS (SELECT source, list_filter(list_transform(tags, lambda x: lower(split_part(x, '-', 1))), lambda x: x IN ('en', 'es', 'pt', 'de', 'fr', 'it', 'nl')) AS l FROM t), o AS (SELECT source, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL) AS l FROM b) SELECT source, CASE WHEN len(l) = 0 THEN 'en' ELSE array_to_string(l, ',') END AS languages FROM o",
    "quote_vectors": f"""WITH {C.ARCHIVE}, a AS (SELECT id, text, regexp_extract(text, '^\\S+ \\S+ \\S+') AS first FROM arch), b AS (SELECT id, CASE WHEN id % 3 = 0 THEN strpos(text, substr(text, 101, 60)) - 1 WHEN id % 3 = 1 THEN 0 END AS s, CASE id % 3 WHEN 0 THEN 60 WHEN 1 THEN length(first) END AS n, CASE id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'loose' END AS how
 FROM a WHERE length(text) > 200 AND first <> '' AND first = regexp_replace(first, '[^ -~]', '', 'g') AND upper(first) <> first) SELECT id, s::INT AS start, (s + n)::INT AS "end", how FROM b""",
    "snippet_vectors": f"""WITH {C.ARCHIVE}, x AS (SELECT id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS g FROM arch),
 u AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM x),
 p AS (SELECT id, i, {C.FOLD.format(x="w")} AS term, sum(length(g) + length(w)) OVER (PARTITION BY id ORDER BY i) AS e, length(w) AS n FROM u),
 t AS (SELECT id, term, (e - n)::BIGINT AS s, e::BIGINT AS e, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY id) AS m FROM p WHERE term <> '' AND length(term) <= 64),
 q AS (SELECT id, max(m) AS m, max(term) FILTER (WHERE k = m // 3) AS a, max(term) FILTER (WHERE k = 2 * m // 3) AS b FROM t WHERE id % 5 <> 4 GROUP BY id),
 h AS (SELECT t.id, t.k, q.m, t.term = a AS first, a <> b AND t.term = b AS second FROM t JOIN q ON t.id = q.id AND t.term IN (a, b)),
 d AS (SELECT id, k, m, max(k) OVER f AS last, 1000 * (max(first::INT) OVER f + max(second::INT) OVER f) + count(*) OVER f AS worth FROM h WINDOW f AS (PARTITION BY id ORDER BY k RANGE BETWEEN CURRENT ROW AND 40 FOLLOWING)),
 o AS (SELECT id, greatest(0, arg_min(k, (-worth, k)) - 8) AS low, least(any_value(m) - 1, arg_min(last, (-worth, k)) + 8) AS high FROM d GROUP BY id),
 b0 AS (SELECT o.*, x.text, l.s, r.e FROM o JOIN x USING (id) JOIN t l ON l.id = o.id AND l.k = low JOIN t r ON r.id = o.id AND r.k = high),
 b1 AS (SELECT *, substr(text, greatest(0, s - 120) + 1, least(s, 120)) AS before, strpos(substr(text, e + 1, 120), '. ') AS dot FROM b0),
 b2 AS (SELECT *, CASE WHEN contains(before, '. ') THEN greatest(0, s - 120) + length(regexp_extract(before, '(?s)^(.*)\\. ', 1)) + 2 ELSE s END AS s2, CASE WHEN dot > 0 THEN e + dot ELSE e END AS e1 FROM b1),
 b3 AS (SELECT *, least(e1, s2 + 260) AS e2, substr(text, s2 + 1, least(e1, s2 + 260) - s2) AS y FROM b2),
 b4 AS (SELECT *, s2 + length(y) - length(ltrim(y, {_SPACE})) AS s3, e2 - length(y) + length(rtrim(y, {_SPACE})) AS e3 FROM b3),
 b5 AS (SELECT id, low, high, s3, greatest(s3, e3) AS e3, length(text) AS n, CASE WHEN s3 > 0 THEN 1 ELSE 0 END AS lead, CASE WHEN s3 > 0 THEN '…' ELSE '' END || substr(text, s3 + 1, greatest(s3, e3) - s3) AS y FROM b4),
 mk AS (SELECT b5.id, count(*) AS marks, string_agg((t.s - s3 + lead) || '-' || (t.e - s3 + lead), ',' ORDER BY k) AS ranges FROM b5 JOIN t ON t.id = b5.id AND k BETWEEN low AND high AND t.s >= s3 AND t.e <= e3 JOIN q ON q.id = t.id AND term IN (a, b) GROUP BY b5.id)
 SELECT x.id, CASE WHEN b5.id IS NULL THEN trim(left(text, 260), {_SPACE}) || CASE WHEN length(text) > 260 THEN '…' ELSE '' END ELSE y || CASE WHEN e3 < n AND right(y, 1) NOT IN ('.', '!', '?') THEN '…' ELSE '' END END AS text, coalesce(marks, 0) AS marks, coalesce(ranges, '') AS ranges
 FROM x LEFT JOIN b5 USING (id) LEFT JOIN mk USING (id)""",
    "phrase_vectors": f"""WITH {C.ARCHIVE}, a AS (SELECT id, regexp_replace(left(text, 200), '^[…\\s]+|[…\\s]+$', '', 'g') AS t FROM arch), b AS (SELECT id, t, regexp_extract(t, '(?s)^(.*?)(?:[.!?](?:\\s|$)|$)', 1) AS sentence FROM a),
 c AS (SELECT id, list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '')[1:10] AS x, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')[1:10] AS y FROM b)
 SELECT id, CASE WHEN len(x) >= 4 THEN array_to_string(x, ' ') WHEN len(y) >= 4 THEN array_to_string(y, ' ') END AS phrase FROM c""",
    "marked_vectors": f"WITH {C.ARCHIVE}, a AS (SELECT id, title, length(regexp_extract(title, '^\\S*')) AS n FROM arch) SELECT id, '<mark>' || {_ESC('left(title, n)')} || '</mark>' || {_ESC('substr(title, n + 1)')} AS html FROM a",
    "rule_normalised": """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://(?:[^@/?#]*@)?([^/:?#]*)', 1), '^www\\.', ''), '\\.+$', '') AS h, regexp_extract(lower(trim(url)), '^[a-z]+://[^/?#]*/+([^?#]*)', 1) AS p FROM pages)
 SELECT page_id, CASE WHEN p IN ('', '*') THEN h WHEN ends_with(p, '/') THEN h || '/' || p || '*' ELSE h || '/' || p END AS rule FROM u""",
    "when_parsed": f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_ms(date_trunc('year', ts)) WHEN 1 THEN epoch_ms(date_trunc('day', ts)) WHEN 2 THEN CASE WHEN event_id % 900 >= 1970 THEN NULL ELSE {C.NOW} - (event_id % 900) * {DAY} END
 WHEN 3 THEN epoch_ms(date_trunc('second', ts)) - 7200000 END AS ms FROM events""",
    "query_parsed": f"""WITH w AS (SELECT doc_id, source, list_transform([0, 1, 2, 3], lambda i: regexp_extract(text, '^\\s*' || repeat('\\S+\\s+', i) || '(\\p{{L}}+)', 1)) AS w FROM documents)
 SELECT doc_id, w[1] <> '' OR w[2] <> '' AS phrase, {C.FOLD.format(x="w[3]")} AS terms, lower(source) || '.example' AS site, epoch_ms(make_timestamp(2024, 1, doc_id % 28 + 1, 0, 0, 0)) AS after FROM w""",
    "utf8_cuts": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE left(text, coalesce(list_max(list_filter(range(0, 102), lambda i: strlen(left(text, i)) <= 101)), 0)) END AS cut FROM documents",
    "clock_holds": f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS now, (event_id % 13 - 1) * {DAY} AS passed, (event_id % 5 - 1) * 36000000 AS held FROM events),
 p AS (SELECT *, CASE WHEN passed > 7 * {DAY} THEN 'more time has passed than an hourly sweep can account for' WHEN passed < -3600000 THEN 'the clock has moved backwards since the last sweep' END AS problem FROM e)
 SELECT event_id, CASE WHEN problem IS NOT NULL THEN problem WHEN held > 0 AND held <= {DAY} THEN 'the clock jumped recently' END AS problem, CASE WHEN problem IS NOT NULL THEN now + {DAY} WHEN held > 0 AND held <= {DAY} THEN now + held ELSE 0 END AS until FROM p""",
    "settings_checked": "SELECT event_id, CASE WHEN value >= 1 THEN value ELSE 12 END AS months, CASE WHEN event_id * 1000 - 5000 >= 1 THEN (event_id * 1000 - 5000)::DOUBLE ELSE 524288000 END AS cap, CASE WHEN event_id % 2 = 0 THEN 'strict' ELSE 'broad' END AS mode FROM events",
    "size_words": """WITH a AS (SELECT doc_id, doc_id * doc_id * 12345 AS b, doc_id * doc_id * 12345 / 15360.0 AS p FROM documents)
 SELECT doc_id, format('{:,}', (CASE WHEN p < 1000 THEN greatest(1, floor(p / 10 + 0.5) * 10) WHEN p < 100000 THEN floor(p / 1000 + 0.5) * 1000 ELSE floor(p / 100000 + 0.5) * 100000 END)::BIGINT) AS pages,
 CASE WHEN b < 1073741824 THEN floor(b / 1048576.0 + 0.5)::BIGINT || 'MB' WHEN b % 1073741824 = 0 THEN (b // 1073741824) || 'GB' ELSE printf('%.1f', (b / 1073741824.0)::DOUBLE) || 'GB' END AS size FROM a""",
    "pdf_magic": "SELECT doc_id, coalesce(doc_id % 3 = 0 OR doc_id % 3 = 2 AND starts_with(text, '%PDF-'), false) AS pdf FROM documents",
    "canonical_links": "SELECT page_id, CASE WHEN page_id % 4 <> 0 AND contains(html, '<title>') THEN url END AS link FROM pages",
    "sensitive_fields": f"SELECT page_id, [{', '.join(str(x).lower() for x in ASKS)}][page_id % {len(FIELDS)} + 1] AS sensitive FROM pages",
    "secret_url": "SELECT page_id, page_id % 4 IN (0, 3) AS secret FROM pages",
    "private_host": "SELECT event_id, CASE event_id % 8 WHEN 2 THEN event_id * 37 % 256 BETWEEN 16 AND 31 WHEN 5 THEN event_id * 37 % 256 BETWEEN 64 AND 127 WHEN 6 THEN false ELSE true END AS private FROM events",
    "archive_levels": f"WITH {C.ARCHIVE}, a AS ({_LEVEL}) SELECT site, domain, day, grouping_id(site, domain, day)::BIGINT AS level, count(*) AS pages, count(*) FILTER (WHERE pinned) AS pinned, min(last_seen) AS oldest, max(last_seen) AS newest FROM a GROUP BY ROLLUP (site, domain, day)",
    "archive_cube": f"WITH {C.ARCHIVE}, a AS ({_LEVEL}) SELECT site, domain, day, grouping_id(site, domain, day)::BIGINT AS level, count(*) AS pages FROM a GROUP BY CUBE (site, domain, day)",
    "last_before": "SELECT v.event_id, t.event_id AS last_event, t.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'view') t ON v.user_id = t.user_id AND v.ts >= t.ts",
}
