"""Language identification by Bayesian evidence fusion.

For each language l and text t with declared markup language d, address suffix s
and host h the posterior is proportional to

    P(t | l) ** TEMPER * P(d | l) * P(s | l) * P(l | h)

* P(t | l): hashed byte trigrams of the lower-cased letters, whole texts, with
  counts from a bounded sample of each declared language (``SAMPLE`` distinct
  texts, drawn by hash), so a language's model depends neither on
  the table's size nor on copies;
* P(d | l), P(s | l): smoothed counts of declared languages and suffixes by the
  language that the text alone points to, over all rows;
* P(l | h): host counts over all rows, smoothed towards their domain's (the last
  two labels of the host), which are smoothed towards the whole corpus's.

A row's own vote is taken out of all counts before it is judged by them.

One more class, ``und``, has evenly spread trigrams and a small prior; a text that
no known language explains better than that is not identified.

Scale: the likelihoods are computed once, and settled with the rows in the shared
folder; counts and judgement are built-in expressions over those.  Besides, two
reads of the texts fit the model: the first deals (declared, hash) pairs, the
second fetches the sample.  Only hashes, the sampled texts and counts by (host,
declared, text language) are shuffled; the host table is broadcast only if its
counted entries are few and joined by host otherwise (AQE splits a hot host).

Defined results: a null or wordless text has no text evidence and is ``und``; a
null declared language or host is no evidence, nor is a host whose texts point to
no language; a host without a dot has no suffix and is its own domain; with no
declared row at all everything is ``und``; repeated rows, ties (the first language
in order wins) and null ids need no special care, as rows are judged one by one; an
empty table gives an empty result; other columns pass through, but for those
called ``language`` or ``confidence``, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.store import batched, col, free, others, settle, small, table
from pagevault.sources import html

SAMPLE = 4000  # most distinct texts of one declared language that are counted to fit the trigram model
MIN_ROWS = 20  # declared rows a language needs in the whole table (or a fifth of all declared rows)
BUCKETS = 1 << 14
TEMPER = 0.3  # trigrams of a text depend on each other
UNKNOWN = "und"
UNKNOWN_PRIOR = 1e-3
KAPPA_HOST, KAPPA_DOMAIN, SMOOTH = 20.0, 50.0, 1.0
CONFIDENT = 0.5
BROADCAST_ENTRIES = 2_000_000  # counts of hosts and declared languages, 8 bytes each: the most that are broadcast

_LETTER = np.full(256, 32, dtype=np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and whether it counts (its middle is a letter)."""
    x = np.full(len(raw) + 2, 32, dtype=np.uint32)
    x[1:-1] = _LETTER[raw]
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(18)).astype(np.int32), x[1:-1] != 32


def _counts(docs: DataFrame, text: str, declared: str) -> dict[str, np.ndarray]:
    """Trigram counts by declared language over the rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for t, d in zip(batch.column(0), batch.column(1), strict=True):
                raw, name = np.frombuffer((t.as_py() or "").encode("utf-8", "replace"), dtype=np.uint8), d.as_py()
                rows[name] = rows.get(name, 0) + 1
                if name not in held:
                    held[name] = np.zeros(BUCKETS, dtype=np.int64)
                for i in range(0, len(raw), W.PIECE):
                    h, ok = trigrams(raw[i : i + W.PIECE])
                    held[name] += np.bincount(h[ok], minlength=BUCKETS)
        for name, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"l": [name] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(x[at], rows[name])})

    out: dict[str, np.ndarray] = {}
    for r in batched(docs).select(text, declared).mapInArrow(run, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.l, np.zeros(BUCKETS + 1))[r.bucket] += r.n
    return out


def fit(docs: DataFrame, text: str = "text", declared: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probabilities (BUCKETS, languages + 1); the last column is ``und``."""
    known = docs.where(col(declared).isNotNull() & col(text).isNotNull()).select(col(declared).alias("_said"), col(text).alias("_text"), F.xxhash64(col(text)).alias("_hash"))
    hashes = settle(known.groupBy("_said", "_hash").agg(F.count(F.lit(1)).alias("_n")), "hashes")
    n = hashes.agg(F.sum("_n")).first()[0] or 0
    if not n:
        return [], np.zeros((BUCKETS, 1), dtype=np.float32)
    modelled = settle(hashes.groupBy("_said").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_texts")).where(F.col("_rows") >= min(MIN_ROWS, n / 5)), "languages")
    # by chance of the hash about twice the sample first, so that no task orders all texts of a language
    share = F.pmod("_hash", F.lit(1 << 31)) / F.lit(float(1 << 31)) * F.col("_texts") < F.lit(2 * sample + 100)
    place = F.row_number().over(Window.partitionBy("_said").orderBy("_hash"))
    picked = hashes.join(small(modelled), "_said").where(share).withColumn("_place", place).where(F.col("_place") <= sample).select("_said", "_hash")
    counts = _counts(known.join(small(settle(picked, "picked")), ["_said", "_hash"]).dropDuplicates(["_said", "_hash"]), "_text", "_said")
    langs = sorted(counts)
    logs = np.full((BUCKETS, len(langs) + 1), -np.log(BUCKETS), dtype=np.float32)
    for i, k in enumerate(langs):
        x = counts[k][:-1]
        logs[:, i] = np.log((x + 0.5) / (x.sum() + 0.5 * BUCKETS))
    return langs, logs


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> Column:
    """Column: log-likelihood of the text under each language and ``und``; empty for a wordless text."""
    held = batched(docs).sparkSession.sparkContext.broadcast(model[1])

    @F.arrow_udf("array<double>")
    def likelihood(texts: pa.Array) -> pa.Array:
        logs = held.value
        raw, offsets = W.column_bytes(texts)
        out = []
        for i, j in W.blocks(offsets):
            total = np.zeros((j - i, logs.shape[1]))
            some = np.zeros(j - i, dtype=np.int64)
            apart, begins = W.spaced(raw, offsets, i, j)  # no trigram spans two texts
            for lo in range(0, len(apart), W.PIECE):
                hi = min(len(apart), lo + W.PIECE)
                h, ok = trigrams(apart[lo:hi])
                at = np.clip(begins - lo, 0, hi - lo)
                cum = np.zeros(hi - lo + 1)
                np.cumsum(ok, out=cum[1:])
                some += np.diff(cum[at]).astype(np.int64)
                for c in range(logs.shape[1]):
                    np.cumsum(np.where(ok, logs[h, c], 0), out=cum[1:], dtype=np.float64)
                    total[:, c] += np.diff(cum[at])
            out += [x.tolist() if n else [] for x, n in zip(total, some, strict=True)]
        return pa.array(out, type=pa.list_(pa.float64()))

    return likelihood(col(text))


def _best(ll: Column) -> Column:
    return F.when(F.size(ll) > 0, F.array_position(ll, F.array_max(ll)) - 1)


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``docs`` with ``language`` and ``confidence``, its posterior probability."""
    columns = others(docs, "language", "confidence")
    model = model or fit(docs, text, declared)
    langs = model[0]
    if not langs:
        return docs.select(*[col(c) for c in columns], F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"))
    n = len(langs)
    ll, vote, of, claim, c, d, s, said, logs, c_all, d_all = free(docs, "_ll", "_vote", "_of_host", "_claim", "_hosts", "_domains", "_suffixes", "_said_by", "_logs", "_in_host", "_in_domain")
    best = F.when(_best(F.col(ll)) < n, _best(F.col(ll)).cast("int"))
    rows = settle(docs.withColumn(ll, scored(docs, model, text)), "likelihoods").withColumn(vote, best)
    seen = rows.select(col(host).alias("_host"), col(declared).alias("_said"), F.col(vote).alias("_l"))
    counts = settle(seen.where(F.col("_l").isNotNull()).groupBy("_host", "_said", "_l").agg(F.count(F.lit(1)).alias("_n")), "evidence")
    by = [F.coalesce(F.sum(F.when(F.col("_l") == i, F.col("_n"))), F.lit(0)).alias(f"c{i}") for i in range(n)]
    names = [F.col(f"c{i}") for i in range(n)]
    whole = [x or 0 for x in counts.agg(*by).first()]

    suffix = F.when(F.col("_host").contains("."), F.element_at(F.split(F.lower("_host"), r"\."), -1))
    domain = F.array_join(F.slice(F.split(F.lower("_host"), r"\."), -2, 2), ".")
    domain = F.when(F.col("_host").contains("."), domain).otherwise(F.lower("_host"))
    hosts = counts.where(F.col("_host").isNotNull()).groupBy("_host").agg(*by).withColumns({"_suffix": suffix, "_domain": domain})
    added = lambda key, to: hosts.groupBy(F.col(key).alias(f"{key}2")).agg(F.array(*[F.sum(x) for x in names]).alias(to))
    joined = hosts.join(added("_domain", d), F.col("_domain") == F.col("_domain2")).join(added("_suffix", s), F.col("_suffix") == F.col("_suffix2"), "left")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    per_host = joined.select(F.col("_host").alias(of), F.array(*names).alias(c), d, s, total(F.array(*names)).alias(c_all), total(F.col(d)).alias(d_all))
    per_host = small(settle(per_host, "hosts"), BROADCAST_ENTRIES // (3 * n))
    claims = counts.where(F.col("_said").isNotNull()).groupBy(F.col("_said").alias(claim)).agg(*by).select(claim, F.array(*names).alias(said))
    per_claim = small(settle(claims, "declared"), BROADCAST_ENTRIES // n)
    both = rows.join(per_host, col(host) == F.col(of), "left").join(per_claim, col(declared) == F.col(claim), "left")

    own = lambda i: F.when(F.col(vote) == i, 1.0).otherwise(0.0)
    voted = F.when(F.col(vote).isNotNull(), 1.0).otherwise(0.0)
    at = lambda x, i: F.get(F.col(x), i) - own(i)
    everywhere = F.array(*[F.lit(float(x)) for x in whole])

    def evidence(i: Column) -> Column:
        """Log of P(l | h) P(s | l) P(d | l) for language i, the row's own vote left out."""
        mine = F.get(everywhere, i) - own(i)
        prior = (mine + SMOOTH) / (F.lit(float(sum(whole))) - voted + SMOOTH * n)
        near = (at(d, i) + KAPPA_DOMAIN * prior) / (F.col(d_all) - voted + KAPPA_DOMAIN)
        here = F.when(F.col(c).isNull(), prior).otherwise((at(c, i) + KAPPA_HOST * near) / (F.col(c_all) - voted + KAPPA_HOST))
        ends = F.when(F.col(s).isNull(), 0.0).otherwise(F.log((at(s, i) + SMOOTH) / (mine + SMOOTH * 2)))
        says = F.when(F.col(said).isNull(), 0.0).otherwise(F.log((at(said, i) + SMOOTH) / (mine + SMOOTH * (n + 1))))
        return F.log(here) + ends + says

    weighed = both.withColumn(logs, F.when(F.size(ll) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), evidence)))
    known = F.zip_with(F.slice(ll, 1, n), F.col(logs), lambda t, e: t * TEMPER + e)
    even = F.element_at(ll, n + 1) * TEMPER + F.lit(float(np.log(UNKNOWN_PRIOR))) + F.array_max(logs)
    fused = weighed.select(*[col(x) for x in columns], F.when(F.col(logs).isNotNull(), F.concat(known, F.array(even))).alias(logs))
    top = F.array_max(logs)
    every = F.array(*[F.lit(x) for x in [*langs, UNKNOWN]])
    return fused.select(
        *[col(x) for x in columns],
        F.when(F.col(logs).isNull(), UNKNOWN).otherwise(F.element_at(every, F.array_position(logs, top).cast("int"))).alias("language"),
        F.when(F.col(logs).isNull(), 0.0).otherwise(F.lit(1.0) / F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("confidence"),
    )


def of_pages(pages: DataFrame, id: str = "page_id") -> DataFrame:
    """Raw web pages as rows for ``identify``: id, text, lang (declared in the markup) and source (the host)."""
    said = F.nullif(F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))
    return pages.select(col(id), html.text(F.col("html")).alias("text"), said.alias("lang"), F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("source"))


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs).select("doc_id", F.col("lang").alias("declared"), "language", F.round("confidence", 6).alias("confidence"), ((F.col("language") != UNKNOWN) & (F.col("confidence") >= CONFIDENT)).alias("kept"))


QUERIES = {"op8_language_evidence": op8_language_evidence}
SQL: dict[str, str] = {}
