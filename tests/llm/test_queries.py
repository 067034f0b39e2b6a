"""The registered queries, whole, against independent brute-force versions and DuckDB."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_operators import HARD, HARD_IDS, HARD_LANGS, HARD_SOURCES, links_brute, pii_brute, plain, secrets_brute

from pagevault.llm import catalog, decontaminate, language_id, license_scan, line_dedup, mixing, ngram_join, pii, progressive_jpeg, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(spark, name):
    return {r.doc_id: r for r in catalog.queries()[name](spark, SF).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(spans):
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


@here
def test_op1(spark, docs):
    got = rows(spark, "op1_secret_novelty")
    assert set(got) == set(docs)
    for i, d in docs.items():
        base, r = secrets_brute(d["text"] or ""), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in base) for k in secret_scan.KINDS[:3]] and r.base_sha256 == sha(said(base))
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("novel")] == said(base).split(",") * bool(base) and len(spans) == len(base) + r.n_novel


@here
def test_op4(spark, docs):
    got = rows(spark, "op4_pii_anchors")
    assert set(got) == set(docs)
    for i, d in docs.items():
        base, r = pii_brute(d["text"] or ""), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS[:4]] and r.base_sha256 == sha(said(base))
        assert r.spans.startswith(said(base)) and r.n_total == len(base) + r.n_url + r.n_account + r.n_address == (len(r.spans.split(",")) if r.spans else 0)


def test_planted_personal_data():
    """Every kind planted in ordinary prose is found: recall 1 over 400 spans of 8 forms."""
    rng = np.random.default_rng(8)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    filler = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(3, 30))))

    def card():
        n = "4" + digits(14)
        return n + next(c for c in "0123456789" if pii.luhn(n + c))

    forms = {
        "email": lambda: f"a{digits(2)}@mail{digits(1)}.example.com", "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), "card": card, "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "url": lambda: f"https://x.example/p?id={digits(4)}", "account": lambda: f"AcCoUnT: {digits(8)}", "address": lambda: f"{int(rng.integers(1, 999))} Baker Street, London {digits(5)}", "street": lambda: f"Hauptstraße {int(rng.integers(1, 99))}, {digits(5)} Berlin",
    }
    found = 0
    for _ in range(50):
        for kind, make in forms.items():
            value = make()
            text = f"{filler()} {value} {filler()}"
            kind = "address" if kind == "street" else kind
            spans = [text[a:b] for k, a, b in pii.scan(text) if k == kind]
            found += any(s in value or value in s for s in spans)
    assert found == 400
    assert not [x for x in pii.scan("Down the Road 5 people met in Drive 3 and the street was 5 long, on account of nothing") if x[0] in ("address", "account")]


@here
def test_op6(spark, docs):
    got = rows(spark, "op6_progressive_jpeg")
    assert set(got) == set(docs)
    for i, d in list(docs.items()):
        raw, r = (d["text"] or "").encode(), got[i]
        payload = raw + b"\xff" * (-len(raw) % 576) if raw else b"\xff" * 576
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = progressive_jpeg.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r.rgb) == r.height * r.width * 3
        assert r.feature == progressive_jpeg.feature(np.frombuffer(r.rgb, dtype=np.uint8).reshape(r.height, r.width, 3))


@here
@pytest.mark.parametrize("name", ["op2_site_line_dedup", "op7_poisson_mixing"])
def test_native(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    res = duck.sql(catalog.oracle_sql()[name])
    at = [res.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in res.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def hard(spark, *more):
    """Hard rows with columns that clash with results and helpers."""
    names = ["language", "confidence", "copy", "shuffle_key", "_count", "_a", "_b", "_row", "n_lines", "_ll", "odd.name", "a", "root"]
    data = [(HARD_IDS[i], t, HARD_LANGS[i], HARD_SOURCES[i], len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(HARD)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))


@pytest.mark.parametrize("limit", [300_000, 0])
def test_lines_hard(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)  # the second way salts and joins
    df = hard(spark)
    many = df.unionByName(df).unionByName(df).unionByName(df).unionByName(df)
    con = duckdb.connect()
    con.register("documents", many.select("doc_id", "source", "text").toPandas().astype({"doc_id": "Int64"}).replace({np.nan: None}))
    out = line_dedup.drop_boilerplate(many, counts=("n_lines", "n_dropped"))
    assert set(out.columns) == set(df.columns) | {"n_dropped"} and len(out.columns) == len(set(out.columns))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, out.select("doc_id", "source", "text", "n_lines", "n_dropped").collect())) == sorted(map(key, con.sql(line_dedup.SQL_TEXT).fetchall()))
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_independent_hashes(spark):
    """The second hash is no function of the first: it differs where a first hash is forced to be equal."""
    from pyspark.sql import functions as F

    from pagevault.llm.store import content

    plan = spark.range(1).select(*content(F.lit("x").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"xxhash64\(7, cast\(x as string\)", plan), plan


def mix_brute(table, seed="mix-1", weights=None):
    """Rows (text, source, id) to their copies, by the documented rule; ids single and not null."""
    n = collections.Counter(r["source"] for r in table)
    w = {s: 1.0 if weights is None else weights.get(s or "", 0.0) for s in n}
    out = []
    for r in table:
        rate = w[r["source"]] / sum(w.values()) * len(table) / n[r["source"]]
        parts = max(1, math.ceil(rate / 32))
        m, count = rate / parts, 0
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"{seed}:{r['doc_id']}:{i}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-m)
            k = 0
            while c <= u and k < 127:
                k += 1
                p *= m / k
                c += p
                count += 1
            count += c <= u
        out += [(r["doc_id"], k, hashlib.md5(f"{seed}:order:{r['doc_id']}:{k}".encode()).hexdigest()) for k in range(1, count + 1)]
    return sorted(out)


@here
def test_op7_brute(spark, docs):
    got = catalog.queries()["op7_poisson_mixing"](spark, SF).collect()
    assert sorted((r.doc_id, r["copy"], r.shuffle_key) for r in got) == mix_brute(list(docs.values()))


def test_mixing_odd_ids(spark):
    df = spark.createDataFrame([(None, "t", "a", 1, "x")] * 3000 + [(5, "u", "b", 1, "x")] * 1500 + [(6, "v", "b", 2, "y"), (7, "w", None, 2, "y")], "doc_id long, text string, source string, copy int, shuffle_key string")
    out = mixing.mix(df, weights={"a": 3000 / 4502, "b": 1501 / 4502, "": 1 / 4502})
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"] and len({r.shuffle_key for r in got}) == len(got) and abs(len(got) - 4502) < 300
    assert max(collections.Counter(r["copy"] for r in got).values()) < 3200  # counts differ from row to row
    order = lambda x: sorted(map(tuple, x.collect()), key=lambda r: r[-1])
    assert order(mixing.mix(df)) == order(mixing.mix(df.repartition(7)))
    assert set(mixing.mix(hard(spark)).columns) == set(hard(spark).columns) and mixing.mix(hard(spark).limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 400_000, "a")], "doc_id long, text string, source string")
    assert all(len(r.text) == 2_000_000 for r in mixing.mix(long, scale=2.0).collect())


@here
def test_op3(spark, docs):
    got = rows(spark, "op3_toxicity_bigru")
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_training_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    texts = [None if i % 4 == 1 else f"text {i}" for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(400)] + [(None, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.training_rows(docs, labels)
    assert collections.Counter(y for _, y in got) == {0: 20, 1: 20}  # labels of absent and empty texts take nobody's place
    assert all(zlib.crc32(t.split()[-1]) % 5 != 0 and int(t.split()[-1]) % 4 != 1 for t, _ in got)
    assert got == toxicity.training_rows(docs.repartition(5), labels.repartition(3)) and toxicity.training_rows(docs.limit(0), labels) == []
    assert toxicity.score_texts(docs.limit(0), None).count() == 0
    twice = toxicity.training_rows(docs.unionByName(docs), labels)
    assert len(twice) <= 40 and set(twice) <= {(t.encode(), y) for t, y in ((texts[i], int(i % 3 == 0)) for i in range(200)) if t}


# --- 5: decontamination by brute force ---

UNITS = {u.decode() for u in decontaminate.UNITS}
LATIN = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}


def template(text):
    """(token, is a slot, value, is a name, opens a sentence in capitals) of each template token."""
    out, before = [], 0
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        raw, word = m.group(), m.group().translate(LATIN)
        number = re.fullmatch("[0-9]+", raw) is not None
        gap = text[before : m.start()]
        opens = not out or re.search(r"[!.:?\n\r]", gap) is not None
        title = re.match("[A-Z]", raw) and len(raw) > 1 and re.match("[a-z]|[^\x00-\x7f]", raw[1]) or re.match("[À-ÖØ-Þ]", raw) and len(raw.encode()) > 2
        attached = re.fullmatch("([0-9]+)(.+)", raw)
        quantity = bool(not number and attached and attached[2].translate(LATIN) in UNITS)
        name, opening = bool(title and not opens and not number), bool(title and opens and not number)
        if out and gap in (".", ",") and number and out[-1][5]:
            out[-1][2] += (word,)
        elif out and gap == " " and word in UNITS and out[-1][5]:
            out[-1][2] += (word,)
            out[-1][0], out[-1][5] = "QUANTITY", False
        else:
            kind = "NUMBER" if number else "QUANTITY" if quantity else "NAME" if name else word
            out.append([kind if number or quantity or name else ("word", word), number or quantity or name, (word,), name, opening, number])
        before = m.end()
    return out


def windows_brute(text, sizes):
    """(kind, start, window, slot values) of every window of a text."""
    t = template(text)
    out = []
    for size in [min(8, len(t))] * bool(t) if sizes is None else sizes:
        for p in range(len(t) - size + 1):
            w = t[p : p + size]
            exact = tuple(("value", x[2]) if x[1] and len(x[2]) > 1 else ("word", x[2][0]) if x[1] else x[0] for x in w)
            values = tuple(x[2] for x in w if x[1] and not x[3])
            out.append(("exact", p, (size, exact), values))
            if size < 4:
                continue
            literal = sum(not x[1] for x in w)
            if literal >= 0.6 * size:
                out.append(("holder", p, (size, tuple(x[0] for x in w)), tuple(x[2] for x in w if x[1])))
            if any(x[3] for x in w) and sum(not (x[1] and not x[3]) for x in w) >= 0.6 * size:
                out.append(("holder", p, (size, tuple(("word", x[2][0]) if x[3] else x[0] for x in w)), values))
            if (any(x[3] for x in t) or any(x[4] for x in t)) and literal >= 0.6 * size and sum(not (x[1] or x[4]) for x in w) >= 0.5 * size:
                out.append(("opening", p, (size, tuple("NAME" if x[4] else x[0] for x in w)), tuple(x[2] for x in w if x[1] or x[4])))
    return out


def contaminated_brute(texts, items):
    mine = {i: windows_brute(t, None) for i, t in items.items() if t is not None}
    sizes = sorted({w[2][0] for ws in mine.values() for w in ws})
    at = collections.defaultdict(list)
    for i, ws in mine.items():
        for kind, p, w, values in ws:
            at[kind, w].append((i, p, values))
    out = {}
    for d, text in texts.items():
        lines = collections.defaultdict(lambda: {k: [set(), set()] for k in ("holder", "exact", "opening", "every")})
        for kind, p, w, values in windows_brute(text or "", sizes):
            for i, q, other in at.get((kind, w), ()):
                if len(values) == len(other):
                    line = lines[i, p - q]
                    line[kind][0].add(q)
                    line[kind][1].update(zip(other, values, strict=True))
                    if kind != "opening":
                        line["every"][1].update(zip(other, values, strict=True))
        steady = lambda pairs: len({a for a, _ in pairs}) == len(pairs)
        some, exact = collections.defaultdict(set), collections.defaultdict(set)
        for (i, _), line in lines.items():
            for kind in ("holder", "opening"):
                if steady(line[kind][1]):
                    some[i] |= line[kind][0]
            if steady(line["every"][1]):
                exact[i] |= line["exact"][0]
        for i in {i for i, _ in lines}:
            total, whole = (len({p for k, p, *_ in mine[i] if k == kind}) for kind in ("holder", "exact"))
            share = max(len(some[i]) / total if total else 0, len(exact[i]) / whole if whole else 0)
            if share >= 0.3:
                out[d, i] = round(share, 6)
    return out


@here
@pytest.mark.parametrize("few", [2_000_000, 0])
def test_op5(spark, docs, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)  # the second way sends all windows into the join
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    want = contaminated_brute({i: d["text"] for i, d in docs.items()}, items)
    got = {(r.doc_id, r.item_id): r.share for r in catalog.queries()["op5_template_decontamination"](spark, SF).collect()}
    assert got == want and got


def test_op5_brute_templates(spark):
    items = {0: "A train leaves Paris at 9 and travels 120 km in 3 hours. How far does the train go in 5 hours at that speed?", 1: "Anna has 3 red apples. Ben has 5 green pears.", 2: "What is 17 * 23 + 4?", 3: "x", 4: None, 5: "Élan costs 1,000.50 euros in Zürich and 5km away 7 more"}
    texts = {0: "so " + items[0].replace("120", "77").replace("Paris", "Rome"), 1: "Cara has 4 red apples. Dan has 7 green pears.", 2: "12 what is 17 * 23 + 4? ok", 3: "x y", 4: None, 5: items[5].replace("Zürich", "Wien").replace("5km", "6km"), 6: "A train leaves Paris at 9. " * 30, 7: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r._id, r.item): round(r.share, 6) for r in decontaminate.contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert got == contaminated_brute(texts, items) and {(0, 0), (1, 1), (2, 2), (3, 3), (5, 5)} <= set(got)


# --- 8: language by brute force ---


def language_brute(table):
    """doc id to (language, confidence) over rows with fewer distinct texts than the sample."""
    declared = collections.Counter(r["lang"] for r in table if r["lang"] is not None and r["text"] is not None)
    least = min(language_id.MIN_ROWS, sum(declared.values()) / 5)
    langs = sorted(k for k, n in declared.items() if n >= least)
    grams = lambda t: (lambda h, ok: h[ok])(*language_id.trigrams(np.frombuffer((t or "").encode(), dtype=np.uint8)))
    logs = []
    for k in langs:
        n = np.zeros(language_id.BUCKETS)
        for t in {r["text"] for r in table if r["lang"] == k and r["text"] is not None}:
            np.add.at(n, grams(t), 1)
        logs.append(np.log((n + 0.5) / (n.sum() + 0.5 * language_id.BUCKETS)).astype(np.float32).astype(float))
    logs.append(np.full(language_id.BUCKETS, np.float32(-math.log(language_id.BUCKETS)), dtype=float))
    like = [[x[g].sum() for x in logs] if len(g) else None for g in (grams(r["text"]) for r in table)]
    vote = [None if x is None or max(x) == x[-1] and x.index(max(x)) == len(langs) else x.index(max(x)) for x in like]
    host = lambda r: r["source"]
    domain = lambda h: ".".join(h.lower().split(".")[-2:]) if "." in h else h.lower()
    suffix = lambda h: h.lower().split(".")[-1] if "." in h else None
    out = {}
    for j, r in enumerate(table):
        if like[j] is None or not langs:
            out[j] = ("und", 0.0)
            continue
        rest = [(vote[k], o) for k, o in enumerate(table) if k != j and vote[k] is not None]
        known = host(r) is not None and any(vote[k] is not None and o["source"] == r["source"] for k, o in enumerate(table))
        said = r["lang"] is not None and any(vote[k] is not None and o["lang"] == r["lang"] for k, o in enumerate(table))
        n, e = len(langs), []
        for i in range(n):
            count = lambda test: sum(1 for v, o in rest if v == i and test(o))  # noqa: B023, E731
            alln = lambda test: sum(1 for _, o in rest if test(o))
            mine = count(lambda o: True)
            prior = (mine + 1) / (len(rest) + n)
            x = math.log(prior)
            if known:
                at_host, at_domain = (lambda o: o["source"] == r["source"]), (lambda o: o["source"] is not None and domain(o["source"]) == domain(r["source"]))
                near = (count(at_domain) + 50 * prior) / (alln(at_domain) + 50)
                x = math.log((count(at_host) + 20 * near) / (alln(at_host) + 20))
                if suffix(r["source"]) is not None:
                    x += math.log((count(lambda o: o["source"] is not None and suffix(o["source"]) == suffix(r["source"])) + 1) / (mine + 2))
            if said:
                x += math.log((count(lambda o: o["lang"] == r["lang"]) + 1) / (mine + n + 1))
            e.append(x)
        z = [like[j][i] * 0.3 + e[i] for i in range(n)] + [like[j][n] * 0.3 + math.log(1e-3) + max(e)]
        out[j] = ([*langs, "und"][z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z))
    return out


@here
def test_op8(spark, docs):
    table = list(docs.values())
    want = language_brute(table)
    got = rows(spark, "op8_language_evidence")
    for j, r in enumerate(table):
        g = got[r["doc_id"]]
        assert g.language == want[j][0] and abs(g.confidence - want[j][1]) < 1e-4 and g.kept == (want[j][0] != "und" and want[j][1] >= 0.5) and g.declared == r["lang"]


def test_language_hosts(spark):
    """Suffix, domain and host decide where the text says little; a row's own vote is left out."""
    rng = np.random.default_rng(3)
    words = {"en": "the of and to with that this".split(), "de": "der die und nicht sich von auch".split()}
    table = []
    for i in range(120):
        k = "de" if i % 3 == 0 else "en"
        table.append({"doc_id": i, "text": " ".join(rng.choice(words[k], 8)), "lang": k if i % 2 else None, "source": f"h{i % 7}.{'bank' if k == 'de' else 'news'}.{'de' if k == 'de' else 'com'}"})
    table += [{"doc_id": 200 + i, "text": t, "lang": None, "source": s} for i, (t, s) in enumerate([("dx", "h0.bank.de"), ("dx", "h0.news.com"), ("dx", "new.bank.de"), ("dx", None), ("", "h0.bank.de"), (None, None), ("der the", "lonely.org")])]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], "old", 3.0) for r in table], "doc_id long, text string, lang string, source string, language string, confidence double")
    out = language_id.identify(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "language", "confidence"]
    want = language_brute(table)
    for r in out.collect():
        j = next(j for j, x in enumerate(table) if x["doc_id"] == r.doc_id)
        assert r.language == want[j][0] and abs(r.confidence - want[j][1]) < 1e-5
    assert language_id.identify(hard(spark)).count() == len(HARD) and language_id.identify(hard(spark).limit(0)).count() == 0


@here
def test_pages(spark):
    p = language_id.of_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))  # enough pages of each language
    got = language_id.identify(p, model=None).collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got) and all("." in r.source for r in got)


# --- 9 ---


@here
def test_op9(spark, docs):
    ids = sorted(docs)
    want = links_brute([docs[i]["text"] for i in ids])
    got = rows(spark, "op9_bayes_jaccard_join")
    assert [(got[i].class_id, got[i].n_links, got[i].group_id) for i in ids] == [(ids[a], n, ids[b]) for a, n, b in want]


def test_join_odd_ids(spark):
    base = [" ".join(f"w{i * 7 + j}" for j in range(60)) for i in range(4)]
    texts = [base[0]] * 40 + [base[0].replace("w3 ", "zz ")] * 40 + [base[1]] * 2 + [base[2], base[3], None, ""]
    ids = [None] * 60 + [7] * 20 + list(range(100, 106))
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, a string, root string, `odd.name` string")
    out = ngram_join.jaccard_join(df)
    assert out.count() == len(texts) and {(r.class_size, r.n_links) for r in out.where("doc_id IS NULL").collect()} == {(40, 1)}
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 5 and sorted(len(r.text or "") > 0 for r in kept.collect()) == [False, True, True, True, True]


def test_open_buckets(spark, monkeypatch):
    """Members that their hub does not take are still connected with each other, in any number of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "ROWS", 1)  # bands of one value: many chance collisions
    monkeypatch.setattr(ngram_join, "bands", lambda v: v[:, :24].astype(np.int64) * 64 + np.arange(24))
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, 70))
        for _ in range(4):
            near = list(base)
            near[int(rng.integers(0, 70))] = "edit"
            texts.append(" ".join(near))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in ngram_join.jaccard_join(df).collect()}
    assert [got[i] for i in range(len(texts))] == links_brute(texts)


# --- 10 ---


def licenses_brute(text):
    w = plain(text)
    places = sorted((i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    grams = collections.defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for name, t in license_scan.TEMPLATES.items():
        t = t.split()
        n = len(t) - 2
        by = collections.defaultdict(set)
        for a in range(n):
            for p in grams.get(tuple(t[a : a + 3]), ()):
                by[p - a].add(a)
        chain, last, chains = [], None, []
        for d in sorted(by):
            if last is None or d - last > 4:
                chain = []
                chains.append(chain)
            chain += [(d + a, a) for a in by[d]]
            last = d
        most = 0
        for chain in chains:
            chain.sort()
            reach = math.floor(1.5 * len(t)) - 3
            for p, _ in chain:
                most = max(most, len({a for q, a in chain if p <= q <= p + reach}))
        if most >= 0.5 * n:
            labels.add(name)
            score = max(score, most / n)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


@here
def test_op10(spark, docs):
    got = rows(spark, "op10_license_diagonals")
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: licenses_brute(d["text"]) for i, d in docs.items()}


def test_license_chains(spark):
    mit, isc = license_scan.TEMPLATES["mit-text"], license_scan.TEMPLATES["isc"]
    rng = np.random.default_rng(9)
    torn = lambda t: " ".join(w for w in t.split() if rng.random() > 0.06)
    texts = [mit + " of the software" * 200, "of the software " * 300 + mit + " of the software" * 50, torn(mit) + " and " + torn(isc), mit.upper() * 3, " ".join(mit.split()[:40]), "under the mit license " * 500, None, "", "x " * 20_000 + isc, mit + " of the software" * 200]
    df = spark.createDataFrame([(i if i < 9 else 0, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = sorted(license_scan.scan(df).collect())
    assert [tuple(r)[1:] for r in got] == [licenses_brute(texts[r.doc_id]) for r in got] and len(got) == len(texts)
    assert "mit-text" in got[0].labels and got[0].score == 1 and license_scan.scan(df.limit(0)).count() == 0


# --- the pipeline ---


def lines_brute(table):
    pages, seen = collections.defaultdict(set), collections.defaultdict(set)
    for r in table:
        pages[r["source"]].add(r["text"])
        if r["text"] is not None:
            for line in set(r["text"].split("\n")):
                if line.strip(" "):
                    seen[r["source"], line].add(r["text"])
    bad = {k for k, v in seen.items() if len(v) >= 5 and len(v) / len(pages[k[0]]) > 0.05}
    cut = lambda r: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)
    return [r | {"text": cut(r), "n_chars": None if cut(r) is None else len(cut(r))} for r in table]


def pipeline_brute(table, items):
    judged = language_brute(table)
    table = [r for j, r in enumerate(table) if judged[j][0] != "und" and judged[j][1] >= 0.5]
    table = sorted(lines_brute(table), key=lambda r: r["doc_id"])
    groups = links_brute([r["text"] for r in table])
    table = [r for j, r in enumerate(table) if groups[j][2] == j]
    gone = {d for d, _ in contaminated_brute({r["doc_id"]: r["text"] for r in table}, items)}
    table = [r for r in table if r["doc_id"] not in gone]
    held = {r["doc_id"]: r for r in table}
    return sorted((i, held[i]["text"], held[i]["lang"], held[i]["source"], held[i]["n_chars"], k, key) for i, k, key in mix_brute(table))


@here
def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    table = [r for r in docs.values()]
    table += [{"doc_id": 10_000 + i, "text": t, "lang": "en", "source": "src1", "n_chars": len(t or "")} for i, t in enumerate([None, "", "9 9 9", "\n\n", table[3]["text"], table[3]["text"] + " more"])]
    spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    assert sorted(map(tuple, out.collect())) == pipeline_brute(table, items)


def test_stages_hard(spark):
    """Every stage takes nulls, empties, ties, repeats, long texts and an empty table."""
    import corpus_pipeline

    bench = spark.createDataFrame([(0, "a b c d e f g h"), (1, None)], "item_id long, text string")
    df = hard(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for table, most in ((df, len(HARD)), (df.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = decontaminate.decontaminated(table, bench) if name == "decontamination" else stage(spark, table, "")
            assert set(df.columns) <= set(out.columns), name
            n = out.count()
            assert n <= most or name == "mixing" and most, name
