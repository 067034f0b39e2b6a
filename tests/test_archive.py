"""Store, index, search, retention and streams on small tables."""

import json

from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault.functions import rules as R
from pagevault.functions import text as X
from pagevault.functions import urls as U
from pagevault.functions.query import parse
from pagevault.operators import index as I
from pagevault.operators import retention as K
from pagevault.operators import search as Q
from pagevault.operators import store as O
from pagevault.operators import versions as V
from pagevault.operators.stemming import stem_udf
from pagevault.sources import exports as E
from pagevault.sources import html as H
from pagevault.streaming import ingest as T

NOW = 1_706_745_600_000
DAY = 86_400_000


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def incoming(spark, *pages):
    full = [(u, t, x, seen, pin, first, visits, i) for i, (u, t, x, seen, pin, first, visits) in enumerate(pages)]
    return spark.createDataFrame(full, "url string, title string, text string, last_seen long, pinned boolean, first_seen long, visit_count int, arrival int")


def empty(spark):
    return spark.createDataFrame([], S.ARCHIVE)


def corpus(spark, texts, **over):
    data = [(i, f"https://h{i % 3}.example/{i}", t.split(".")[0], t, f"h{i % 3}.example", NOW - i * DAY, NOW - i * DAY, False) for i, t in enumerate(texts)]
    return I.Index.of(spark.createDataFrame(data, "id long, url string, title string, text string, domain string, last_seen long, first_seen long, pinned boolean"))


def find(ix, text, **more):
    return [(r.id, r["mode"]) for r in Q.search(ix, [(0, parse(text, NOW))], NOW, **more).orderBy("rank").collect()]


def test_url_keys(spark):
    got = dict(rows(spark.createDataFrame([(u,) for u in (
        "https://www.Example.com/a/?utm_source=x&b=2&a=1#top", "http://example.com:80/", "https://example.com:8443/p", "ftp://x.example/", "https://example.com/?ref=x&gclid=1", "https://example.com/?q=a%20b+c&e",
    )], "url string").select("url", U.url_key(F.col("url")).alias("k"))))
    assert got["https://www.Example.com/a/?utm_source=x&b=2&a=1#top"] == "https://example.com/a?a=1&b=2"
    assert got["http://example.com:80/"] == "http://example.com/" and got["https://example.com:8443/p"] == "https://example.com:8443/p"
    assert got["ftp://x.example/"] is None and got["https://example.com/?ref=x&gclid=1"] == "https://example.com/?ref=x"
    assert got["https://example.com/?q=a%20b+c&e"] == "https://example.com/?e=&q=a%20b%20c"


def test_hash_and_sizes(spark):
    r = spark.createDataFrame([("abc", 1023), ("", 1048575)], "t string, n long").select(X.content_hash(F.col("t")).alias("h"), X.size_text(F.col("n")).alias("s")).collect()
    assert r[0].h.startswith("1a47e90b") and len(r[1].h) == 16 and (r[0].s, r[1].s) == ("1023B", "1.0MB")


def test_fold_agrees(spark):
    words = ["Éclair", "STRAßE", "ñandú", "Ǻngström", "ελληνικά", "plain", "Ünïcödé"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fold(F.col("w")).alias("a"), X.fold_exact("w").alias("b")).collect()
    assert all(r.a == r.b == X.fold_term(r.w) for r in got)


def test_policy(spark):
    cases = {
        "https://mail.google.com./x": "excluded: mail.google.com.", "https://a.example/reset?token=abc": "the address contains a sign-in or access key", "ftp://x/": "not a web page",
        "nonsense": "unparseable url", "https://fine.example/": "ok",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert dict(rows(df.select("url", R.reason(F.col("url"), ["mail.google.com"]).alias("r")))) == cases
    assert rows(df.select(R.reason(F.col("url"), paused=True)))[0][0] == "paused"


def test_upsert(spark):
    u = "https://example.com/a"
    one = O.upsert(empty(spark), incoming(spark, (u + "?utm_source=n", "T", "first text", 100, False, None, None), ("ftp://no", "T", "x", 1, False, None, None)))
    assert rows(one, "id", "url_key", "visit_count", "first_seen", "last_seen") == [(1, u, 1, 100, 100)]
    same = O.upsert(one, incoming(spark, (u, "T", "first text", 50, True, None, None)))
    assert rows(same, "id", "text", "visit_count", "last_seen", "pinned") == [(1, "first text", 2, 100, False)]
    more = O.upsert(O.pin(one, 1), incoming(spark, (u, "T", "new text", 300, False, None, None), (u, "T", "new text", 200, False, None, None), ("https://b.example/", "B", "b", 7, True, 3, 9)))
    assert rows(more, "id", "text", "visit_count", "first_seen", "last_seen", "pinned") == [(1, "new text", 3, 100, 300, True), (2, "b", 9, 3, 7, True)]
    assert rows(O.upsert(one, incoming(spark)), "id", "visit_count") == [(1, 1)]


def test_index(spark):
    ix = corpus(spark, ["cat dog cat bird cat", "", "dog " * 40])
    assert rows(ix.postings.where("term = 'cat' AND id = 0").select("tf", F.col("pos").cast("string"))) == [(6, "[0, 2, 4, 5, 7, 9]")]
    assert ix.postings.where("term = 'dog' AND id = 2").select(F.size("pos")).first()[0] == S.POSITIONS
    assert all(r.n == 0 for r in I.invariants(ix).collect())
    left = I.Index(ix.archive, O.without(ix.postings, ix.archive.where("id = 0")), ix.dictionary)
    assert any(r.n for r in I.invariants(left).collect())


def test_search(spark, tmp_path):
    ix = corpus(spark, ["alpha beta gamma.", "alpha beta. delta", "beta alpha running.", "gamma cars alone.", "alpha."])
    ix.save(f"file://{tmp_path}/ix")
    ix = I.Index.load(spark, f"file://{tmp_path}/ix")
    assert {i for i, _ in find(ix, "alpha beta")} == {0, 1, 2} and find(ix, "alpha beta")[0][1] == "and"
    assert {m for _, m in find(ix, "alpha zzz")} == {"or"}
    assert {i for i, _ in find(ix, '"alpha beta"')} == {0, 1} and {i for i, _ in find(ix, "alpha -beta")} == {4}
    assert {i for i, _ in find(ix, "alpha site:h1.example")} == {1, 4} and {i for i, _ in find(ix, "alpha after:2")} == {0, 1, 2}
    assert [i for i, _ in find(ix, "alpha", recent=True)] == [0, 1, 2, 4]
    assert {i for i, _ in find(ix, "gammas")} == {0, 3} and {i for i, _ in find(ix, "delt")} == {1} and {i for i, _ in find(ix, "alpga")} == {0, 1, 2, 4}
    assert {i for i, _ in find(ix, "runs", languages=["en"], stem=stem_udf)} == {2}
    assert [i for i, _ in find(ix, "alpha", limit=2, offset=2)] == [i for i, _ in find(ix, "alpha")][2:4]
    page = Q.search(ix, [(0, parse("alpha beta", NOW))], NOW, snippets=True).collect()
    assert all(r.snippet.text and r.snippet.ranges for r in page)


def test_crowded(spark):
    ix = corpus(spark, [f"kubernetes cluster notes number {i}. " * 3 for i in range(600)] + ["kubernetes. once"])
    page = Q.search(ix, [(0, parse("kubernetes", NOW))], NOW, limit=30, offset=495).collect()
    assert {r.total for r in page} == {601} and [r.score == 0 for r in sorted(page, key=lambda r: r.rank)] == [False] * 5 + [True] * 25


def test_retention(spark):
    a = spark.createDataFrame([(1, NOW - 400 * DAY, 1000, False), (2, NOW - 10 * DAY, 1000, False), (3, NOW - 9 * DAY, 1000, False), (4, NOW - 500 * DAY, 1000, True)], "id long, last_seen long, bytes long, pinned boolean")
    assert rows(K.plan(a, NOW, 12, None), "id", "reason") == [(1, "age")]
    assert rows(K.plan(a, NOW, 12, 2000), "id", "reason") == [(1, "age"), (2, "size")]
    assert K.summary(K.plan(a, NOW, 12, 2000)).first().asDict() == {"bytes_freed": 2000, "age": 1, "size": 1, "reason": "both"}
    assert rows(K.plan(a, NOW, None, 3000, apply_age=False), "id", "reason") == [(1, "size")]
    assert rows(K.plan(a.limit(0), NOW, 12, 10), "id") == []
    log = spark.createDataFrame([(1, 0, "size", 3, 300), (2, 60_000, "size", 4, 400), (3, 600_000, "size", 5, 500), (4, 5_000_000, "size", 1, 1)], "id long, at long, reason string, count long, bytes_freed long").withColumns({"age": F.lit(0), "size": F.col("count")})
    assert rows(K.merged_log(log), "count", "bytes_freed", "rounds") == [(1, 1, 1), (12, 1200, 3)]


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><link href="https://x.example/c" rel="canonical"></head><body><nav>no</nav><article><h1>Hi</h1><script>x</script><p>One  two<br>three</p></article><input type="password"></body></html>'
    r = spark.createDataFrame([(page,), (None,)], "h string").select(H.title(F.col("h")), H.text(F.col("h")), H.canonical(F.col("h")), H.sensitive(F.col("h"))).collect()
    assert tuple(r[0]) == ("A & B", "Hi\n\nOne two\nthree", "https://x.example/c", True) and r[1][3] is False


def test_exports(spark, tmp_path):
    a = O.upsert(empty(spark), incoming(spark, ("https://a.example/", "A", "text", 1000, True, 500, 2)))
    E.write(a, f"file://{tmp_path}/out")
    with open(f"{tmp_path}/out/part-x.json", "w") as f:
        f.write("{broken\n")
    good, bad = E.read(spark, f"file://{tmp_path}/out")
    assert rows(good, "url", "last_seen", "first_seen", "visit_count", "pinned") == [("https://a.example/", 1000, 500, 2, True)] and bad.count() == 1
    (tmp_path / "one.json").write_text(json.dumps({"format": "f", "settings": {"pages": [1]}, "pages": [{"url": "https://b.example/", "text": "t", "visitCount": 0}]}))
    assert rows(E.read_document(spark, f"file://{tmp_path}/one.json"), "url", "visit_count") == [("https://b.example/", None)]


def test_versions_and_stream(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    incoming(spark, ("https://a.example/", "A", "text", 1000, False, None, None), ("https://a.example/#x", "A", "text", 900, False, None, None)).write.parquet(f"file://{tmp_path}/in")
    pages = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).parquet(f"file://{tmp_path}/in")
    sink = T.upsert_batches(spark, path)
    q = pages.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert rows(V.current(spark, path), "url_key", "visit_count", "last_seen") == [("https://a.example/", 2, 1000)]
    batch = spark.read.parquet(f"file://{tmp_path}/in")
    sink(batch, 0)  # a replayed batch changes nothing
    assert rows(V.current(spark, path), "visit_count") == [(2,)]
    for name in ("one", "two"):  # not even after other changes and a vacuum that forgets the batch's version
        V.publish(V.current(spark, path).withColumn("pinned", F.lit(name == "two")), path, name)
    V.vacuum(spark, path, 1)
    sink(batch, 0)
    assert rows(V.current(spark, path), "visit_count", "pinned") == [(2, True)] and V.processed(spark, path, "batch") == 0
    T.upsert_batches(spark, path, "other")(batch, 0)
    sink(batch, 1)
    assert rows(V.current(spark, path), "visit_count") == [(6,)] and (V.processed(spark, path, "batch"), V.processed(spark, path, "other")) == (1, 0)


def test_dwell_stream(spark, tmp_path):
    spark.createDataFrame([(1, "p", 0), (1, "p", 2500), (1, "p", 5000), (1, "p", 7500), (1, "q", 8000), (1, "q", 90_000)], "user_id long, page string, ms long").select("user_id", "page", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    ticks = spark.readStream.schema("user_id long, page string, ts timestamp").parquet(f"file://{tmp_path}/t")
    q = T.dwell_stream(ticks).writeStream.format("memory").queryName("dwell").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert rows(spark.table("dwell")) == [(1, "p", 5000)]


def test_windows_stream(spark, tmp_path):
    spark.range(10).select(F.timestamp_millis(F.col("id") * 1_800_000).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"file://{tmp_path}/t")
    q = T.windowed(s).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and [r[0] for r in rows(spark.table("win"), "n")] == [2] * 5


def fnv_brute(text):
    out = ""
    for seed in (0x811C9DC5, 0x9E3779B9):
        h = seed
        for c in text:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        out += f"{h:08x}"
    return out


def test_content_hashes_of_long_texts(spark, tmp_path):
    from pagevault.plans import indexing

    texts = ["short é", "x" * 399, "y" * 400, "a longer text, né. " * 900]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(len(texts)).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.content_hash for r in indexing.content_hashes(spark, str(tmp_path)).collect()}
    assert got == {i: fnv_brute(t[:80] + "\n\n" + t) for i, t in enumerate(texts)}


def log_brute(rounds, keep=500):
    out = []
    for id, at, reason, count in sorted(rounds, key=lambda r: (r[1], r[0])):
        if out and out[-1][2] == reason and at - out[-1][1] < S.LOG_GAP_MS:
            out[-1] = (min(out[-1][0], id), at, reason, out[-1][3] + count, out[-1][4] + 1)
        else:
            out.append((id, at, reason, count, 1))
    return sorted(out, key=lambda r: (-r[1], -r[0]))[:keep]


def test_log_of_all_events(spark, tmp_path):
    from pagevault.plans import budget

    spark.range(2500).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.id, r["at"], r.reason, r["count"], r.rounds) for r in budget.log_merge(spark, str(tmp_path)).collect()]
    want = log_brute([(i, i * 400_000 + i * i % 7 * 60_000, "age" if i // 3 % 2 == 0 else "size", i % 5) for i in range(2500)])
    assert got == want and len(got) == 500


def test_log_across_days(spark):
    ats = [0, DAY - 1000, DAY + 1000, DAY + 2000, 2 * DAY + 5, 4 * DAY - 1, 4 * DAY, 5 * DAY - 1, 5 * DAY + S.LOG_GAP_MS]
    rounds = [(i, at, "age" if i < 3 or i > 6 else "size", i + 1) for i, at in enumerate(ats)]
    log = spark.createDataFrame(rounds, "id long, at long, reason string, count long").withColumns({"bytes_freed": F.col("count"), "age": F.lit(0), "size": F.lit(0)})
    assert [(r.id, r["at"], r.reason, r["count"], r.rounds) for r in K.merged_log(log).collect()] == log_brute(rounds)


def test_quotes_of_short_texts(spark, tmp_path):
    from pagevault.plans import retrieval

    texts = ["tiny", "some words of a text " * 8, "other words of a text " * 40]
    spark.createDataFrame([(2 * i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(6).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: (r.start, r.end) for r in retrieval.quote_locate(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 2, 4} and got[0] == (None, None) and None not in got[2] + got[4]
