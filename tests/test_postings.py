"""Postings are made where the pages are, by the definition of tokens."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault.functions import text as X
from pagevault.operators import index as I
from pagevault.operators import store as O
from pagevault.plans import indexing as C

TEXTS = [
    "The cat, the dog and THE cat", None, "", " \n ", "x" * 64 + " " + "y" * 65 + " tail " + "ß" * 33 + " " + "ß" * 32, "Été ÉTÉ été Straße ΣΊΣΥΦΟΣ İstanbul", "αͺβ the ͺ΄γ", "été ñ", "数字 ١٢ Ⅷ 𝒜𝒷 😀 a_b",
    " ".join(["the"] * 40 + ["end"]),
]


def by_definition(archive):
    rows = I.tokens(archive).groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.slice(F.sort_array(F.collect_list("pos")), 1, S.POSITIONS).alias("pos"))
    return sorted(tuple(r) for r in rows.select("term", "id", "tf", "pos").collect())


def word_by_word(c):
    """Each word folded by itself."""
    folded = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(X.WORD), F.lit(0)), X.fold)
    return F.transform(folded, lambda t: F.when((t != "") & (F.length(t) <= S.TERM_CHARS), t))


def test_postings_by_definition(spark):
    a = spark.createDataFrame([(i * 300 - 300, None if i % 2 else "A Title", t) for i, t in enumerate(TEXTS)], "id long, title string, text string")
    got = I.postings(a)
    assert sorted(tuple(r) for r in got.collect()) == by_definition(a) and got.schema.names == S.POSTINGS.names
    whole = X.indexed_text(F.col("title"), F.col("text"))
    for r in a.select(X.terms(whole).alias("a"), word_by_word(whole).alias("b"), X.count_terms(whole).alias("n")).collect():
        assert r.a == r.b and r.n == sum(t is not None for t in r.a)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # a task holds a batch, not its share of the tokens
    first = {}
    for t, i, *_ in sorted(by_definition(a), key=lambda p: p[1]):
        first.setdefault((t, i >> S.BUCKET_BITS), i)
    want = {}
    for t, i, _, pos in by_definition(a):
        want[i] = want.get(i, 0) + S.ENTRY_BYTES + S.POSITION_BYTES * len(pos) + (first[t, i >> S.BUCKET_BITS] == i) * (S.RECORD_BYTES + S.TERM_BYTES * len(t.encode()))
    assert {r.id: r.index_bytes for r in I.index_bytes(got).collect()} == want


def test_cells(spark, tmp_path, monkeypatch):
    """A list longer than a cell is spread over ranges of ids; searches still read it whole."""
    monkeypatch.setattr(I, "CELL_ROWS", 100)
    a = spark.range(-40, 1500).selectExpr("id", "'t' AS title", "concat('common word', id) AS text", "1 AS last_seen")
    I.Index.of(a).save(f"file://{tmp_path}/ix")
    ix = I.Index.load(spark, f"file://{tmp_path}/ix")
    assert all(r.n == 0 for r in I.invariants(ix).collect())
    found = I.lists(ix.postings, I.named(spark.createDataFrame([("common",)], "term string")))
    assert found.where("term = 'common'").count() == 1540 and found.select(F.input_file_name()).distinct().count() > 5


def test_unposted(spark):
    """Postings of deleted pages go; the others are not shuffled by id for that."""
    ids = [-129, -64, -1, 0, 1, 63, 64, 65, 127, 128, 1 << 40, (1 << 63) - 1]
    p = spark.createDataFrame([(t, i, 1, [0]) for t in ("a", "b") for i in [*ids, None]], S.POSTINGS)
    gone = spark.createDataFrame([(i,) for i in [*ids[::2], 7, -2, ids[0], None]], "id long")
    for g in (gone, gone.limit(0)):
        got = O.unposted(p, g)
        assert got.columns == p.columns and sorted(map(str, got.collect())) == sorted(map(str, O.without(p, g).select(*p.columns).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.QUERIES["deleted_postings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 1 and "LeftAnti" not in plan  # that of the archive's two tables


def test_saved_in_order(spark, tmp_path, monkeypatch):
    """Files are sorted by term and id (or block); tasks read bounded shares of the archive, which is tokenised where it was saved."""
    monkeypatch.setattr(I, "TASK_BYTES", 1 << 16)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    a = spark.range(0, 6000, 1, 3).selectExpr("id", "'t' AS title", "concat_ws(' ', transform(sequence(1, 30), k -> substring(sha2(string((id * 7 + k * k) % 400), 256), 1, 9))) AS text")
    I.Index.of(a.orderBy(F.hash("id"))).save(f"file://{tmp_path}/ix")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    for table, then in (("postings", "id"), ("impacts", "block")):
        files = list((tmp_path / "ix" / table).rglob("*.parquet"))
        for f in files:
            rows = pq.ParquetFile(f).read(columns=["term", then]).to_pylist()
            assert [tuple(r.values()) for r in rows] == sorted(tuple(r.values()) for r in rows)
        assert len(files) == 16
    assert all(pq.ParquetFile(f).metadata.row_group(0).total_byte_size < 1 << 18 for f in (tmp_path / "ix" / "archive").glob("*.parquet"))
    assert all(r.n == 0 for r in I.invariants(I.Index.load(spark, f"file://{tmp_path}/ix")).collect())


def test_cells_of_one_bucket(spark, tmp_path, monkeypatch):
    """A cell never reaches into the next bucket, even where ids begin late in a block; its impacts are made by one task, and rows come in order without a sort by folders."""
    monkeypatch.setattr(I, "CELL_ROWS", 256)
    a = spark.range(255, 767).selectExpr("id", "'' AS title", "concat('common x', id % 97, ' y', id) AS text")
    I.Index.of(a).save(f"file://{tmp_path}/ix")
    assert all(r.n == 0 for r in I.invariants(I.Index.load(spark, f"file://{tmp_path}/ix")).collect())
    for table, then in (("postings", "id"), ("impacts", "block")):
        folders = [list(f.glob("*.parquet")) for f in (tmp_path / "ix" / table).glob("of=*/bucket=*")]
        held = [[pq.ParquetFile(f).read(columns=["term", then]).to_pylist() for f in files] for files in folders]
        assert all([tuple(r.values()) for r in rows] == sorted(tuple(r.values()) for r in rows) for files in held for rows in files)
        tasks = [{f.name.split("-")[1] for f in files} for files in folders]
        assert sum(map(len, tasks)) == len(set().union(*tasks)) and max(map(len, tasks)) <= 2  # a task's cell is of one bucket


def test_stretches(monkeypatch):
    """Postings of a batch are made by stretches of pages, each in order of term and id; pages without words are in none."""
    b = pa.RecordBatch.from_arrays([pa.array([9, 4, 7, 1]), pa.array([["b", "a", "b"], ["a", "c"], None, ["c", "", "b"]])], names=["id", "words"])
    whole = [tuple(r.values()) for out in I._grouped(iter([b])) for r in out.to_pylist()]
    assert whole == [("a", 4, 1, [0]), ("a", 9, 1, [1]), ("b", 1, 1, [2]), ("b", 9, 2, [0, 2]), ("c", 1, 1, [0]), ("c", 4, 1, [1])]
    monkeypatch.setattr(I, "STRETCH", 4)
    parts = [[tuple(r.values()) for r in out.to_pylist()] for out in I._grouped(iter([b]))]
    assert len(parts) > 1 and all(p == sorted(p) for p in parts) and sorted(sum(parts, [])) == whole


def test_impacts_of_whole_cells(spark, tmp_path):
    """Impacts are read off the sorted cells, a task a file, whatever the session's split size; runs go on from batch to batch."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.maxRecordsPerFile", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("4096", "50", "7"), strict=True):
            spark.conf.set(k, v)
        a = spark.range(0, 3000).selectExpr("id", "'' AS title", "concat('common common x', id % 97, ' y', id) AS text")
        I.Index.of(a).save(f"file://{tmp_path}/ix")
        ix = I.Index.load(spark, f"file://{tmp_path}/ix")
        assert all(r.n == 0 for r in I.invariants(ix).collect())
        assert all(len(list(f.glob("*.parquet"))) == 1 for t in ("postings", "impacts") for f in (tmp_path / "ix" / t).glob("of=*/bucket=*"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    b = pa.RecordBatch.from_arrays([pa.array(["a", "a", "a", "b", "b"]), pa.array([-1, 0, 255, 255, 256]), pa.array([1, 2, 9, 1, 3], pa.int32())], names=["term", "id", "tf"])
    for n in range(1, 6):
        parts = [b.slice(0, 0), *(b.slice(k, n) for k in range(0, 5, n))]
        got = [tuple(r.values()) for out in I._runs(iter(parts)) for r in out.to_pylist()]
        assert got == [("a", -1, 1, 1), ("a", 0, 9, 2), ("b", 0, 1, 1), ("b", 1, 3, 1)]


def test_bucket_steps():
    """Buckets grow with the corpus in steps of four, so that cells stay of a size."""
    rows = [1 << k for k in range(20, 34)]
    assert all(r <= I.buckets_for(r) * I.BUCKET_ROWS < 8 * max(r, I.BUCKETS[0] * I.BUCKET_ROWS) for r in rows)


def test_saved_tables_are_small(spark, tmp_path):
    """What a build writes is compressed well."""
    I.Index.of(spark.range(0, 300).selectExpr("id", "'t' AS title", "concat('common word', id % 50) AS text")).save(f"file://{tmp_path}/ix")
    for table in ("archive", "postings", "impacts", "dictionary"):
        files = list((tmp_path / "ix" / table).rglob("*.parquet"))
        assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.read_metadata(f).num_rows} == {"ZSTD"}
