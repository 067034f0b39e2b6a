"""Embedding near-duplicates, periodic runs and spelling variants against brute force, and on hard rows."""

import hashlib
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_operators import HARD, HARD_IDS, table

from pagevault.llm import catalog, decontaminate, embedding_near, ngram_join, periodic_runs, pii, progressive_jpeg, secret_scan, spelling_variants

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_sql(name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(catalog.oracle_sql()[name])


# --- embeddings ---


def components_brute(linked):
    root = list(range(len(linked)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, row in enumerate(linked):
        for j in np.flatnonzero(row):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(linked))]


def near_brute(vectors, threshold=0.9):
    """Per vector: rows linked to it and the first index of its component."""
    n = len(vectors)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    linked = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], dtype=float), np.array(vectors[j], dtype=float)
                x, y = x / abs(x).max(), y / abs(y).max()
                linked[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    return linked.sum(axis=1), components_brute(linked)


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")


def clustered(rng, n, d, narrow):
    """Vectors in clusters around a few directions, some of them copies."""
    centres = rng.normal(size=(5, d)) * (np.arange(d) < narrow)
    x = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, d)) * rng.choice([0.01, 0.2, 0.5, 2], size=(n, 1))
    x[n // 2 : n // 2 + 5] = x[0]
    return x


@pytest.mark.parametrize(("d", "narrow"), [(3, 3), (24, 24), (40, 2)])
def test_near_pairs(d, narrow):
    rng = np.random.default_rng(d)
    x = clustered(rng, 300, d, narrow)
    u = embedding_near.unit(x)
    turn = embedding_near.axes(u.T @ u)
    assert np.allclose(turn.T @ turn, np.eye(d))
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i < j}
    block, embedding_near.BLOCK = embedding_near.BLOCK, 64
    try:
        for lead in (1, 4, 16):
            got = [p for i, j in embedding_near.links(x, x, turn, same=True, lead=lead) for p in zip(i.tolist(), j.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) == want
            got = {p for i, j in embedding_near.links(x[:100], x[100:], turn, lead=lead) for p in zip(i.tolist(), (j + 100).tolist(), strict=True)}
            assert got == {p for p in want if p[0] < 100 <= p[1]}
    finally:
        embedding_near.BLOCK = block


def test_threshold_is_met_exactly():
    x = np.array([[1.0, 0, 0, 0], [9, 3, 3, 1], [9, 3, 3, 1.0000001]])
    got = [p for i, j in embedding_near.links(x, x, np.eye(4), same=True, lead=1) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert (0, 1) in got and (0, 2) not in got


@pytest.mark.parametrize("tile", [8192, 16])
def test_near_duplicates(spark, monkeypatch, tile):
    """Clusters along few axes (so that a grid is formed), vectors of other lengths, copies, bad rows, huge and tiny values."""
    monkeypatch.setattr(embedding_near, "TILE", tile)
    rng = np.random.default_rng(7)
    x = [v.tolist() for v in clustered(rng, 120, 8, 2)] + [v.tolist() for v in clustered(rng, 30, 3, 3)]
    x += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1e300] * 8, [1e-300] * 8, [1e-310] * 8, [1e300, -1e300] * 4, [2.0]]
    order = rng.permutation(len(x))
    x = [x[i] for i in order]
    counts, roots = near_brute(x)
    got = {r.vec_id: r for r in embedding_near.near_duplicates(vectors_table(spark, [(i, v, None, "x") for i, v in enumerate(x)])).collect()}
    assert len(got) == len(x)
    for i, v in enumerate(x):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (counts[i], roots[i], roots[i] == i), v


def test_near_ids(spark):
    rows = [(None, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 2, ""), (2, [0.99, 0.1], 1, ""), (None, None, 1, ""), (None, [0.0, 1.0], 1, ""), (9, [-1.0, 0.0], None, "")]
    got = sorted(map(str, embedding_near.near_duplicates(vectors_table(spark, rows)).collect()))
    want = [(None, 3, 2, False), (3, 3, 2, False), (3, 3, 2, False), (2, 3, 2, True), (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(f"Row(vec_id={a}, n_links={b}, component_id={c}, kept={d})" for a, b, c, d in want)
    empty = embedding_near.near_duplicates(vectors_table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "`a.id` long, `the vector` array<float>")
    assert {tuple(r) for r in embedding_near.near_duplicates(odd, "the vector", "a.id").collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


@here
def test_op11(spark):
    got = sorted(map(tuple, catalog.queries()["op11_embedding_near"](spark, SF).collect()))
    assert got == sorted(by_sql("op11_embedding_near", "embeddings").fetchall()) and len(got) == pq.read_table(f"{SF}/embeddings.parquet").num_rows


# --- periodic runs ---


def runs_brute(x):
    """(start, length, period) of every run, by comparing all words q apart."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        s = 0
        while s + q < len(x):
            e = s
            while e + q < len(x) and x[e] == x[e + q]:
                e += 1
            if e + q - s >= max(12, 2 * q) and e > s:
                out[s, e + q] = min(q, out.get((s, e + q), q))
            s = max(e, s + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed_brute(x):
    gone = {i for s, n, q in runs_brute(x) for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(x) if i not in gone)


def sequences(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        x = [r.choice("abcdefghij"[: r.choice([1, 2, 2, 3, 10])]) for _ in range(r.randint(0, 90))]
        if len(x) > 5 and r.random() < 0.5:
            p = r.randint(1, len(x) // 2)
            x = [x[i % p] for i in range(len(x))]
            if r.random() < 0.5:
                x[r.randrange(len(x))] = "z"
        yield [w.encode() for w in x]


def test_runs():
    held = list(sequences(1, 400))
    for lo in range(0, len(held), 4):  # several texts in one block
        for x, (n, found, kept) in zip(held[lo : lo + 4], periodic_runs.collapse([b"\t ".join(x) for x in held[lo : lo + 4]]), strict=True):
            assert n == len(x) and found == runs_brute(x) and kept == collapsed_brute(x)


class Lying(periodic_runs.Hashes):
    """Hashes by which words are equal further than they are."""

    def equal(self, a, b, size):
        return super().equal(a, b, np.where(size > 14, 14, size)) if len(a) and not (size == b - a).all() else super().equal(a, b, size)


def test_runs_in_small_rounds_and_with_lying_hashes():
    for x in sequences(2, 60):
        w = np.unique(np.array(x, dtype=object).astype(str), return_inverse=True)[1] if x else np.zeros(0, dtype=np.int64)
        want = [(s, s + n, q) for s, n, q in runs_brute(x)]
        for options in ({}, {"pairs": 7}, {"hashes": Lying}):
            assert [tuple(r) for r in periodic_runs.runs(w, **options).tolist()] == want


def test_runs_of_long_texts():
    n = 200_000
    _, found, kept = periodic_runs.collapse([b"a " * n])[0]
    assert found == [(0, n, 1)] and kept == b"a"
    words = [str(i) for i in range(n // 4)]
    _, found, kept = periodic_runs.collapse([" ".join(words * 3 + ["end"]).encode()])[0]
    assert found == [(0, n // 4 * 3, n // 4)] and kept.decode() == " ".join([*words, "end"])


def test_collapse_runs_on_hard_rows(spark):
    texts = [*HARD, "\x0b".join(["x y"] * 8), "x y " * 20, "a\x1fb " * 12]
    docs = table(spark, texts, ids=[*HARD_IDS, 12, 13, 14], sources=["s"] * len(texts), langs=["en"] * len(texts))
    got = periodic_runs.collapse_runs(docs).collect()
    want = []
    for i, t in zip([*HARD_IDS, 12, 13, 14], texts, strict=True):
        x = (t or "").encode().split()
        short = x[:400]  # brute force is quadratic; the one longer text repeats one word
        runs = [(s, len(x), q) if len(x) > 400 else (s, n, q) for s, n, q in runs_brute(short)]
        want.append((i, len(x), runs, None if t is None else collapsed_brute(short).decode()))
    assert sorted(map(str, [(r[0], r[1], [tuple(y) for y in r[2]], r[3]) for r in got])) == sorted(map(str, want))
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("k", "a " * 12, 1)], "`doc.id` string, `runs` string, n_words int")
    assert periodic_runs.collapse_runs(odd, "runs", "doc.id").collect()[0][:2] == ("k", 12)


@here
def test_op12(spark):
    got = {r.doc_id: r for r in catalog.queries()["op12_periodic_runs"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert set(got) == {d["doc_id"] for d in docs}
    some = 0
    for d in docs:
        x, h = (d["text"] or "").encode().split(), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and x:
            g = h // 10
            a = g % len(x)
            p = 1 + (len(x) - a) // (3 + g % 8)
            x = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)]
        found = runs_brute(x)
        some += len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert tuple(got[d["doc_id"]])[1:] == (len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(collapsed_brute(x)))
    assert some > 20


# --- spelling variants ---


def near_words(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_brute(texts, every=None, ids=None, min_length=5, min_count=3):
    counts = {}
    for i, t in enumerate(texts):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            key = i if ids is None else ids[i]
            h = zlib.crc32(f"{key}:{w}".encode())
            if every and key is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near_words(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        out[w] = [n, len(close), best if best and counts[best] >= 2 * n else None]
    rows = {}
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (form, root, n, k, counts[form] if form else None)
    return rows


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants(spark):
    """Words over few letters, so that bigrams repeat within words and among them, with chains of forms."""
    r = random.Random(3)
    words = list({"".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(250)})
    words += ["kkkkkkkkkk"[:n] for n in range(5, 11)] + ["abababab", "babababa", "ababababa", "ÀÖØöø÷×ÿé", "letter" * 20, "letter" * 20 + "s"]
    texts = [" ".join(r.choice([w, w.upper() if w.isascii() else w]) for w in words for _ in range(r.choice([1, 1, 2, 5, 9]))) for _ in range(4)] + [None, "", "x", "12 34", "kkkkk-kkkkk_kkkkk9"]
    ids = [0, 1, 2, 2, None, 5, 6, 7, None]
    docs = table(spark, texts, ids=ids, sources=["s"] * 9, langs=["en"] * 9)
    assert as_rows(spelling_variants.spelling_variants(docs)) == variants_brute(texts)
    want = variants_brute(texts, 5, ids)
    assert as_rows(spelling_variants.spelling_variants(docs, every=5)) == want
    assert any(f and want[f][0] for f, *_ in want.values())  # a form with a form
    assert spelling_variants.spelling_variants(docs.limit(0)).count() == 0


def test_roots(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)]
    got = dict(map(tuple, spelling_variants.roots(spark.createDataFrame(chain + [("a", "b")], "word string, form string")).collect()))
    assert got == {**{w: "w070" for w, _ in chain}, "a": "b"}


@here
def test_op13(spark):
    got = sorted(map(tuple, catalog.queries()["op13_spelling_variants"](spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    sql = by_sql("op13_spelling_variants", "documents")
    assert sql.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got == sorted(sql.fetchall())
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    few = [d for d in docs if d["doc_id"] < 40]
    assert got and as_rows(spelling_variants.spelling_variants(spark.createDataFrame([(d["doc_id"], d["text"]) for d in few], "doc_id long, text string"), every=97)) == variants_brute([d["text"] for d in few], 97, [d["doc_id"] for d in few])


# --- secrets in long runs; id columns of any name ---


def test_secret_after_a_long_run():
    r = random.Random(4)
    key = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(64))
    for n in (50, 1900, 2100, 60_000):
        text = "bearer " + "x1" * n + "_signature_" + key
        assert [x[:3] for x in secret_scan.scan(text)] == [("novel", len(text) - 65, len(text))], n


def test_secrets_take_time_in_proportion():
    """Many credentials in one text, and many cues in one run."""
    took = []
    for n in (4000, 16_000):
        began = time.process_time()
        assert len(secret_scan.base(("token=abcdef12\n" * n).encode())) == n
        secret_scan.novel(("bearer_" + "token_a1b2_" * n).encode(), [])
        secret_scan.novel(b"token: x1y2z3w4v5u6t7s8 \n" * n, [("assign", k * 25, k * 25 + 3) for k in range(n)])
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


@pytest.mark.parametrize("id", ["doc.id", "spans", "n_bytes", "a`b"])
def test_ids_of_any_name(spark, id):
    docs = spark.createDataFrame([(1, "mail me at joe@example.com, token: 'abcdefgh1234'")], f"`{id.replace('`', '``')}` long, text string")
    secrets, personal = secret_scan.secret_spans(docs, id=id), pii.personal_spans(docs, id=id)
    name = "_spans" if id == "spans" else "spans"
    assert secrets.columns == personal.columns == [id, name] and secrets.first()[1][0].kind == "assign" and personal.first()[1][0].kind == "email"
    media = progressive_jpeg.read_media(progressive_jpeg.store_media(docs, id=id), id=id, tensors=False)
    assert media.columns[0] == id and media.columns[1] == ("_n_bytes" if id == "n_bytes" else "n_bytes") and media.first()[:2] == (1, 49)


# --- n-gram join: pages of one template ---


def template_pages(n, near, share=80, own=40):
    """Pages that have a template in common and words of their own; of some, near copies."""
    r = random.Random(n)
    word = lambda: "w" + format(r.randrange(10**9), "x")
    frame = [word() for _ in range(share)]
    pages = [frame + [word() for _ in range(own)] for _ in range(n)]
    for i in range(near):
        copy = list(pages[i * 7 % n])
        copy[100 + i % 10] = word()
        pages.append(copy)
    r.shuffle(pages)
    return [" ".join(p) for p in pages]


def test_template_pages(spark):
    """Links are those of the near copies, whatever the pages have in common."""
    texts = template_pages(200, 60)
    docs = table(spark, texts, ids=list(range(len(texts))), sources=["s"] * len(texts), langs=["en"] * len(texts))
    got = {r.doc_id: (r.n_links, r.group_id) for r in ngram_join.jaccard_join(docs).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    frame = set.intersection(*sets)
    rest, full = [s - frame for s in sets], len(frame)
    linked = [[j for j, y in enumerate(rest) if j != i and (m := len(x & y)) and (m + full) / (len(x | y) + full) >= 0.8] for i, x in enumerate(rest)]
    assert sum(map(len, linked)) >= 120 and {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in enumerate(linked)}
    for i, x in enumerate(linked):
        assert got[i][1] == min([i, *x, *(z for y in x for z in linked[y])])


# --- decontamination: short items ---


def test_short_items_empty_no_corpus(spark):
    item = "how many apples does anna buy if she pays seven dollars for each"
    texts = ["yes we can", "no", f"the question was: {item}", "yes", None]
    docs = table(spark, texts, ids=[0, 1, 2, 3, 4], sources=["s"] * 5, langs=["en"] * 5)
    given = spark.createDataFrame([(1, "yes"), (2, item), (3, "no no")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminated(docs, given).collect()} == {0, 1, 3, 4}
    told = {(r._id, r.item): r.size for r in decontaminate.contaminated(docs, given).collect()}
    assert told == {(0, 1): 1, (3, 1): 1, (2, 2): 8}
