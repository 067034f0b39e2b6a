"""Functions of single values on given inputs, and the statistics and joins over tables, against what is expected of them."""

import json
import random

from pyspark.sql import functions as F

from pagevault.functions import passages as P
from pagevault.functions import query as G
from pagevault.functions import rules as R
from pagevault.functions import text as X
from pagevault.functions.stem import default_languages, stem
from pagevault.operators import retention as K
from pagevault.operators import store as O
from pagevault.operators import summary as M
from pagevault.settings import normalised
from pagevault.sources import html as H

NOW = 1_706_745_600_000
DAY = 86_400_000
PROSE = "Soup gets better overnight. Cold soup thickens as the starch in it settles and the spices spread. A splash of water brings it back."

# inputs, then what is expected of them
STEMS = [("running", "en", "run"), ("organization", "en", "organiz"), ("chart", "en", "chart"), ("hauser", "de", "haus"), ("huizen", "nl", "huis"), ("lopen", "nl", "loop"), ("word", "xx", None)]
LANGUAGES = [("de-AT,en-US,de", "de,en"), ("ja,zh", "en"), ("", "en"), ("pt-BR,it", "pt,it")]
QUOTES = [
    (PROSE, "Cold soup thickens as", "Cold soup thickens as", "exact"), (PROSE, "cold   SOUP thickens\nas the", "Cold soup thickens as the", "loose"),
    (PROSE, "A splash of water never hurts", "A splash of water", "partial"), (PROSE, "seven lamps on a green boat", None, None), (PROSE, "A splash too many", None, None), ("", "x", None, None), (PROSE, None, None, None),
]
SNIPPETS = [
    (PROSE, "thickens", "Soup gets better overnight. Cold soup thickens as the starch in it settles and the spices spread.", "thickens"), ("", "x", "", ""), ("Brief words.", "lamp", "Brief words.", ""),
    ("One. Two needle three", "needle", "One. Two needle three", "needle"), ("Über den Fluß und den Fluss", "fluss", "Über den Fluß und den Fluss", "Fluß,Fluss"),
]
PHRASES = [("Soup gets better over the night. A splash.", 0, 4, "Soup gets better over the night"), ("one two three four five six seven eight nine ten eleven", 0, 3, "one two three four five six seven eight nine ten"), ("The copper kettle holds two litres", 6, 12, "copper kettle holds two litres"), ("two words", 0, 0, None)]
MARKS = [("a <b> & c", 2, 5, "a <mark>&lt;b&gt;</mark> &amp; c"), ('say "x"', 0, 3, "<mark>say</mark> &quot;x&quot;")]
RULES = [
    ("https://user@www.Example.com:8080/?q#f", "example.com"), ("example.com/", "example.com"), ("example.com/*", "example.com"), ("example.com/en/", "example.com/en/*"), ("*.example.net", "*.example.net"), ("blog.*", "blog.*"), ("example.com..", "example.com"),
    ("@PRIVATE-network", "@private-network"), ("  ", ""), ("www.", "www"),
]
WHENS = [("2024", 1_704_067_200_000), ("1969", NOW - 1969 * DAY), ("30", NOW - 30 * DAY), ("99999999999", 0), ("2024-02", 1_706_745_600_000), ("2024-02-29", 1_709_164_800_000), ("2024-02-31", None), ("soonish", None), ("2024-01-01T12:00:00+02:00", 1_704_103_200_000)]
PARSES = [
    ("Green Lamp", "green,lamp", "", "", None), ('"copper kettle" soup', "soup", "copper kettle", "", None), ("soup site:www.example.com", "soup", "", "", "example.com"), ("green -lamp", "green", "", "lamp", None),
    ("green - lamp", "green,lamp", "", "", None), ("   ", "", "", "", None), ("soup after:soonish", "soup", "", "", None), ('-"not out" kept', "kept", "not out", "", None),
]
CUTS = [("naïve", 3, "na"), ("naïve", 4, "naï"), ("😀😀", 7, "😀"), ("plain", 10, "plain"), ("", 0, "")]
HOLDS = [(NOW, None, None, None, None, 0), (NOW, NOW - 8 * DAY, None, None, "more time has passed than an hourly sweep can account for", NOW + DAY), (NOW, NOW + 2 * 3_600_000, None, None, "the clock has moved backwards since the last sweep", NOW + DAY),
         (NOW, NOW - 1000, NOW + 5000, "p", "p", NOW + 5000), (NOW, NOW - 1000, NOW + 3 * DAY, "p", None, 0), (NOW, NOW + 60_000, None, None, None, 0)]
LIMITS = [("{}", 12, 524_288_000, "broad"), ('{"retention_months": null, "size_cap_bytes": "9"}', 12, 9, "broad"), ('{"retention_months": 0, "mode": "strict"}', 12, 524_288_000, "strict"), ("[1]", 12, 524_288_000, "broad"), ('{"retention_months": 3.5, "size_cap_bytes": -1, "mode": 7}', 3.5, 524_288_000, "broad")]
SIZES = [(0, "1", "0MB"), (15 * 1024 * 994, "990", "15MB"), (15 * 1024 * 1600, "2,000", "23MB"), (500 * 1024**2, "34,000", "500MB"), (1024**3, "70,000", "1GB"), (1_610_612_736, "100,000", "1.5GB"), (10 * 1024**3, "700,000", "10GB")]
PDFS = [("25504446" + "2d312e37", True), ("255044", False), ("", False), ("202550444 62d".replace(" ", ""), False)]
LINKS = [
    ('<head><link rel="stylesheet" href="/s"><link href="https://a.example/x" rel=canonical></head>', "https://a.example/x"), ("<link rel='canonical' href='/one'><link rel='canonical' href='/two'>", "/one"), ("<p>rel=canonical</p>", None), ("<link rel=canonical>", None),
]
FIELDS = [('<input type="password">', True), ('<INPUT autocomplete="cc-number">', True), ("<input type=text name=q>", False), ('<iframe src="https://checkout.stripe.com/c">', True), ('<iframe src="https://js.stripe.com/v3/metrics-1">', False), ("", False)]
SECRETS = {
    "https://a.example/reset?token=abc": True,
    "https://a.example/cb?code=1&state=2": True,
    "https://a.example/x?key=react": False,
    "https://a.example/x?key=Zm9vYmFyYmF6MTIzNDU2": True,
    "https://a.example/x?pageToken=abcdefghijkl": False,
    "https://a.example/x?csrf_token=abcdefghij": True,
    "https://a.example/reset-password/550e8400e29b41d4a716": True,
    "https://a.example/how-to-verify-email-in-2024": False,
    "https://a.example/verify/how-to-verify-email-in-2024": False,
    "https://a.example/f?sig=1&se=2": True,
    "https://a.example/#access_token=zz": True,
    "https://a.example/x?sort_key=date": False,
    "https://a.example/x?private_key=Zm9vYmFyYmF6MTIzNDU2": True,
}
HOSTS = {
    "10.1.2.3": True,
    "127.0.0.1": True,
    "172.16.0.1": True,
    "172.32.0.1": False,
    "192.168.1.1": True,
    "169.254.1.1": True,
    "100.64.0.1": True,
    "100.128.0.1": False,
    "8.8.8.8": False,
    "0.0.0.0": True,
    "[::1]": True,
    "[fe80::1]": True,
    "[fd00::1]": True,
    "[::ffff:c0a8:101]": True,
    "[::ffff:808:808]": False,
    "wiki": True,
    "example.com": False,
    "[2001:db8::1]": False,
}


def given(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {schema}")


def column(df, c):
    return [r[0] for r in df.orderBy("n").select(c).collect()]


def test_plain_functions():
    assert [stem(w, x) for w, x, _ in STEMS] == [s for *_, s in STEMS]
    assert [",".join(default_languages(t.split(",") if t else [])) for t, _ in LANGUAGES] == [x for _, x in LANGUAGES]
    found = [P.locate(page, quote) for page, quote, *_ in QUOTES]
    assert [(page[f[0] : f[1]], f[2]) if f else (None, None) for (page, *_), f in zip(QUOTES, found, strict=True)] == [q[2:] for q in QUOTES]
    shown = [P.snippet(page, [word]) for page, word, *_ in SNIPPETS]
    assert [(t, ",".join(t[a:b] for a, b in ranges)) for t, ranges in shown] == [s[2:] for s in SNIPPETS]
    assert [P.phrase(t, [(a, b)] if b else []) for t, a, b, _ in PHRASES] == [p[3] for p in PHRASES]
    assert [P.marked(t, [(a, b)]) for t, a, b, _ in MARKS] == [m[3] for m in MARKS]
    assert [R.normalise(x) for x, _ in RULES] == [r for _, r in RULES]
    assert [G.parse_when(x, NOW) for x, _ in WHENS] == [w for _, w in WHENS]
    parsed = [G.parse(x, NOW) for x, *_ in PARSES]
    assert [(",".join(q.terms), ",".join(" ".join(p) for p in q.phrases), ",".join(q.exclude), q.site) for q in parsed] == [p[1:] for p in PARSES]
    assert [X.truncate_utf8(t, n) for t, n, _ in CUTS] == [c for *_, c in CUTS]
    assert [K.clock_hold(*h[:4]) for h in HOLDS] == [h[4:] for h in HOLDS]
    limits = [normalised(json.loads(x)) for x, *_ in LIMITS]
    assert [(x.retention_months, x.size_cap_bytes, x.mode) for x in limits] == [x[1:] for x in LIMITS]


def test_columns(spark):
    sizes = given(spark, SIZES, "b long, x string, y string")
    assert (column(sizes, X.pages_for(F.col("b"))), column(sizes, X.describe_size(F.col("b")))) == ([x for _, x, _ in SIZES], [y for *_, y in SIZES])
    assert column(given(spark, PDFS, "h string, x boolean"), O.is_pdf(F.unhex("h"))) == [x for _, x in PDFS]
    assert column(given(spark, LINKS, "html string, x string"), H.canonical(F.col("html"))) == [x for _, x in LINKS]
    assert column(given(spark, FIELDS, "html string, x boolean"), H.sensitive(F.col("html"))) == [x for _, x in FIELDS]
    assert dict(map(tuple, given(spark, [(u,) for u in SECRETS], "url string").select("url", R.secret_in_url(F.col("url"))).collect())) == SECRETS
    assert dict(map(tuple, given(spark, [(h,) for h in HOSTS], "host string").select("host", R.private_host(F.col("host"))).collect())) == HOSTS


def test_as_of(spark):
    """Spans of any length give what a search of all right rows gives, ties, nulls and a hot key included."""
    r = random.Random(8)
    left = [(i, r.choice([1, 1, 1, 2, None]), r.randrange(200)) for i in range(120)]
    right = [(r.choice([1, 1, 1, 3, None]), r.randrange(200), r.choice("abc")) for _ in range(90)]
    want = {}
    for i, k, t in left:
        seen = [(u, v) for key, u, v in right if key is not None and key == k and u <= t]
        want[i] = max(seen)[1] if seen else None
    a, b = spark.createDataFrame(left, "id int, k int, ms long"), spark.createDataFrame(right, "k int, ms long, v string")
    for span in (1, 7, 1000):
        got = M.as_of(a, b, "k", "ms", ["v"], span=span)
        assert got.columns == ["id", "k", "ms", "last_v"] and {x.id: x.last_v for x in got.collect()} == want
    assert M.as_of(a, b.limit(0), "k", "ms", ["v"]).where("last_v IS NOT NULL").count() == 0 and M.as_of(a.limit(0), b, "k", "ms", ["v"]).count() == 0


def test_levels(spark):
    rows = [("a.x.example", 0, True), ("b.x.example", DAY, False), ("b.x.example", DAY + 5, False), ("localhost", None, None)]
    pages = spark.createDataFrame(rows, "domain string, last_seen long, pinned boolean")
    got = {(x.level, x.site, x.domain, x.day): (x.pages, x.pinned) for x in M.overview(pages).collect()}
    assert got[7, None, None, None] == (4, 1) and got[3, "x.example", None, None] == (3, 1) and got[1, "x.example", "b.x.example", None] == (2, 0)
    assert got[0, "x.example", "b.x.example", 1] == (2, 0) and got[0, "localhost", "localhost", None] == (1, 0) and len(got) == 9
    assert M.overview(pages, cube=True).where("level = 6").count() == 3 and M.overview(pages.limit(0)).where("level < 7").count() == 0


def test_one_decimal(spark):
    """As printf writes it, halves included."""
    gb = 1024**3
    sizes = [k * gb // 4 for k in (5, 7, 9, 1237, 111105)] + [n * n * 12345 for n in (16384, 49152, 1_000_003)] + [gb + gb // 20 + k for k in (0, 1)] + [(1 << 45) + gb // 100 * 96]
    got = [tuple(r) for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(X.size_text(F.col("n")), X.describe_size(F.col("n"))).collect()]
    assert got == [(f"{n / gb:.1f}GB",) * 2 for n in sizes]
    small = [1310720, 1835008, 9_000_000]
    assert [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(small)], "i int, n long").orderBy("i").select(X.size_text(F.col("n"))).collect()] == [f"{n / 1048576:.1f}MB" for n in small]


def test_snippets_mark_words(spark):
    """The registered query looks for words that the pages hold: passages inside of them, with marks."""
    from pagevault.plans import texts

    shown = texts.QUERIES["snippet_vectors"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.marks > 1 and r.text.startswith("…") for r in shown) > len(shown) / 4 and any(r.marks == 0 for r in shown)
    assert all(len(r.ranges.split(",")) == r.marks for r in shown if r.marks)
