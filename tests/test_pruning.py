"""Searches that read what they need: buckets of terms, blocks of ids, the near part of the dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault.functions.query import parse
from pagevault.operators import index as I
from pagevault.operators import search as Q

NOW = 1_706_745_600_000


def archive(spark, n, words=()):
    """Pages of a few common words, some of them often, and of words of their own."""
    r = random.Random(n)
    rows = []
    for i in range(n):
        often = r.choice([1, 1, 1, 1, 30]) if i // 256 % 4 == 1 else 1
        text = " ".join(["common"] * often + ["other"] * r.randint(0, 3) + [f"page{i}", *(r.choice(words) if words else "x" for _ in range(3))])
        rows.append((i, f"https://s{i % 3}.example/{i}", "t", f"s{i % 3}.example", text, NOW - i * 1000, i % 9 == 0))
    return spark.createDataFrame(rows, "id long, url string, title string, domain string, text string, last_seen long, pinned boolean")


def saved(spark, path, *more):
    I.Index.of(archive(spark, *more)).save(f"file://{path}")
    return I.Index.load(spark, f"file://{path}")


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


def test_lookups_read_their_buckets(spark, tmp_path):
    few, many = (saved(spark, tmp_path / str(n), n, [f"w{k}" for k in range(n)]) for n in (200, 2000))
    wanted = spark.createDataFrame([("common",), ("page7",)], "term string")
    files = []
    for ix in (few, many):
        found = I.lists(ix.postings, I.named(wanted))
        text = plan(found)
        assert all(c in text.split("PartitionFilters:")[1].split("]")[0] for c in ("of#", "bucket#")) and "PushedFilters: [In(term" in text
        assert {r.term for r in found.select("term").distinct().collect()} == {"common", "page7"}
        listed = found._jdf.queryExecution().executedPlan().collectLeaves().head()  # files that the scan is left with
        listed.executeColumnar().count()
        files.append((listed.metrics().apply("numFiles").value(), len(ix.postings.inputFiles())))
        assert all(r.n == 0 for r in I.invariants(ix).collect())
    assert files[1][0] <= files[0][0] + 2 and files[1][0] * 3 < files[1][1]  # ten times the words, but not more files for these
    near = Q.nearby(many.dictionary, [(0, parse("comman pag", NOW)), (1, parse("t", NOW))])
    assert {r.term[:3] for r in near.collect()} == {"com", "pag", "t"}
    assert I.named(spark.range(I.LOOKUP + 1).selectExpr("string(id) term")) is None and I.lists(many.postings, None).count() == many.postings.count()


def test_block_ranges():
    assert I._ranges([5, 1, 2, 3, 9]) == [(1, 3), (5, 5), (9, 9)] and I._ranges([]) == []
    r = random.Random(1)
    held = {r.randrange(10**6) for _ in range(500)}
    ranges = I._ranges(held)
    assert len(ranges) == I.RANGES and all(any(a <= x <= b for a, b in ranges) for x in held)


QUERIES = ["common other", "common zzq", "common", "common -other", '"common other"', "other site:s1.example", "page1 common", "zzq", "commom other"]


@pytest.mark.parametrize("most", [1, 500])
def test_first_pages(spark, tmp_path, most):
    """The first pages are those of the whole answer, whatever is left out."""
    ix = saved(spark, tmp_path / "ix", 4000)
    asked = [(i, parse(t, NOW)) for i, t in enumerate(QUERIES)]

    def first(found):
        return {(r.query, r.id, round(r.prescore, 9), r.mode) for r in found.orderBy("query", F.desc("prescore"), "id").collect() if not seen.setdefault(r.query, []).append(r.id) and len(seen[r.query]) <= most}

    seen = {}
    want = first(Q.candidates(ix, asked))
    seen = {}
    found, read = Q.top(ix, asked, most)
    assert first(found) == want
    blocks = {r.query: (r.read, r.blocks) for r in read.collect()}
    assert blocks[2][1] == 16 and (blocks[2][0] < 8 or most > 20)  # pages with a high score stand in few blocks
    if most == 500:
        held = {n: f(*a).orderBy("query", "rank").select("query", "rank", "id", "score", "mode").collect() for n, f, a in (("top", Q.first_pages, (ix, asked, NOW)), ("all", Q.search, (ix, asked, NOW)))}
        assert held["top"] == held["all"]


def test_ranges_reach_the_scan(spark, tmp_path):
    ix = saved(spark, tmp_path / "ix", 1000)
    wanted = spark.createDataFrame([("common",)], "term string")
    found = I.lists(ix.postings, I.named(wanted), [1, 2])
    assert "GreaterThanOrEqual(id,256)" in plan(found) and sorted(r.id for r in found.collect()) == list(range(256, 768))
    assert I.lists(ix.impacts, I.named(wanted), [1]).select("most", "pages").first()[1] == 256
    assert set(ix.postings.columns) == {*S.POSTINGS.names, *I.DEALT}
