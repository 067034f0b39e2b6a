"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words enter as the sum of a hashed word embedding and the mean of hashed
character 4-gram embeddings (word ends included), so unseen words are judged by
their letters.  The first coordinate of both embeddings starts as a shrunken
log-odds of the label.  A forward and a backward gated recurrent layer read a
window of ``SPAN`` words; attention pools their states; a logistic unit scores the
window.  Windows overlap by half, all windows of a text are scored, and the
text's score is that of its highest window, calibrated so that 0.5 is the best
cut on held-back training rows.

Labels are of whole texts, so training is multiple-instance: each round the
windows that score highest in a text stand for it.  Training uses at most
``SAMPLE`` rows of each label and ``SAMPLE_BYTES`` bytes (the documented bounds),
on the driver; scoring is a map over the texts with bounded scratch memory and
no shuffle.

Defined results: a null, empty or wordless text scores ``EMPTY_SCORE``; without
any positive or negative training row every text does; repeated rows and ties
score alike; a null id is not held out; an empty table gives an empty result;
extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.store import batched, col, table

SPAN, STRIDE = 16, 8
DIM, HIDDEN, ATTEND = 16, 8, 8
WORD_BITS, CHAR_BITS = 16, 16
SAMPLE = 2000  # most labelled rows of each label that are trained on
SAMPLE_BYTES = 24_000_000  # and most bytes of their texts
ROUNDS = 8
EMPTY_SCORE = 0.0
F32 = np.float32


def inputs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: word buckets, character-gram buckets in order, and grams per word."""
    start, end, h = W.words(raw)
    x = np.full(len(raw) + 3, 32, dtype=np.uint32)
    x[1:-2] = np.where(W.IS_WORD[raw], W.LOWER[raw], 32)
    inside = x != 32
    g = (x[:-3] * np.uint32(0x9E3779B1)) ^ (x[1:-2] * np.uint32(0x85EBCA77)) ^ (x[2:-1] * np.uint32(0xC2B2AE3D)) ^ (x[3:] * np.uint32(0x27D4EB2F))
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    g ^= g >> np.uint32(13)
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), (g & np.uint32((1 << CHAR_BITS) - 1)).astype(np.int64)[inside[1:-2] & inside[2:-1]], end - start - 1


def vectors(word: np.ndarray, gram: np.ndarray, many: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Input vectors (words, DIM)."""
    out = p["word"][word]
    some = many > 0
    if some.any():
        at = (np.cumsum(many) - many)[some]
        out[some] += np.add.reduceat(p["char"][gram], at, axis=0) / many[some, None].astype(F32)
    return out


def frames(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words."""
    return np.arange(0, max(1, n - STRIDE), STRIDE) if n else np.zeros(0, dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _layer(xs: list[np.ndarray], u: np.ndarray, keep: list | None) -> list[np.ndarray]:
    """Hidden states of one direction; xs are the projected inputs by step."""
    h = np.zeros((len(xs[0]), HIDDEN), dtype=F32)
    out = []
    for x in xs:
        hu = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        n = np.tanh(x[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * hu[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, zr, n, hu[:, 2 * HIDDEN :]))
        h = n + zr[:, :HIDDEN] * (h - n)
        out.append(h)
    return out


def forward(x: np.ndarray, index: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray], trace: dict | None = None) -> np.ndarray:
    """Logits of windows: ``index`` (SPAN, windows) into the input vectors ``x``, ``mask`` where a word stands."""
    xf, xb = x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]
    keep_f, keep_b = ([], []) if trace is not None else (None, None)
    hf = _layer([xf[index[t]] for t in range(SPAN)], p["u_f"], keep_f)
    hb = _layer([xb[index[t]] for t in reversed(range(SPAN))], p["u_b"], keep_b)[::-1]
    states = np.concatenate([np.stack(hf), np.stack(hb)], axis=2)
    a = np.tanh(states @ p["attend"])
    e = np.where(mask, a @ p["query"], F32(-30))
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", e, states)
    if trace is not None:
        trace.update(keep_f=keep_f, keep_b=keep_b, states=states, a=a, e=e, pooled=pooled)
    return pooled @ p["out"] + p["out_bias"][0]


def _layer_back(grads: np.ndarray, keep: list, u: np.ndarray, du: np.ndarray) -> list[np.ndarray]:
    """Gradients of the projected inputs by step, of one direction, last step first in time reversed."""
    dh = np.zeros_like(grads[0])
    out: list[np.ndarray] = []
    for t in reversed(range(len(keep))):
        h, zr, n, hn = keep[t]
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        g = grads[t] + dh
        dn = g * (1 - z) * (1 - n * n)
        dz = g * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=1)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dhu
        dh = g * z + dhu @ u.T
        out.append(dx)
    return out[::-1]


def backward(x: np.ndarray, index: np.ndarray, p: dict[str, np.ndarray], trace: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the input vectors."""
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    states, a, e, pooled = trace["states"], trace["a"], trace["e"], trace["pooled"]
    g["out"], g["out_bias"] = pooled.T @ dlogit, np.array([dlogit.sum()], dtype=F32)
    dpool = dlogit[:, None] * p["out"]
    de = np.einsum("tbh,bh->tb", states, dpool)
    dscore = e * (de - (e * de).sum(axis=0))
    dstate = e[:, :, None] * dpool
    g["query"] = np.einsum("tba,tb->a", a, dscore)
    da = dscore[:, :, None] * p["query"] * (1 - a * a)
    g["attend"] = np.einsum("tbh,tba->ha", states, da)
    dstate += da @ p["attend"].T
    dxf = _layer_back(dstate[:, :, :HIDDEN], trace["keep_f"], p["u_f"], g["u_f"])
    dxb = _layer_back(dstate[::-1, :, HIDDEN:], trace["keep_b"], p["u_b"], g["u_b"])[::-1]
    flat = index.reshape(-1)
    dx = np.zeros_like(x)
    for side, d in (("f", dxf), ("b", dxb)):
        d = np.concatenate(d)
        g[f"bias_{side}"] = d.sum(axis=0)
        g[f"in_{side}"] = x[flat].T @ d
        np.add.at(dx, flat, d @ p[f"in_{side}"].T)
    return g, dx


@dataclass
class Text:
    word: np.ndarray
    gram: np.ndarray
    many: np.ndarray
    label: int


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = frames(n)
    index = at[None, :] + np.arange(SPAN)[:, None]
    return np.minimum(index, n - 1), index < n


def logits(t: Text, p: dict[str, np.ndarray], x: np.ndarray | None = None) -> np.ndarray:
    x = vectors(t.word, t.gram, t.many, p) if x is None else x
    index, mask = _windows(len(t.word))
    return np.concatenate([forward(x, index[:, i : i + 4096], mask[:, i : i + 4096], p) for i in range(0, index.shape[1], 4096)])


def _odds(texts: list[Text], buckets: int, part: str) -> np.ndarray:
    hits = np.zeros((2, buckets))
    for t in texts:
        hits[t.label, np.unique(getattr(t, part))] += 1
    n = [max(1, sum(t.label == c for t in texts)) for c in (0, 1)]
    odds = np.log((hits[1] + 0.3) / (n[1] + 0.6)) - np.log((hits[0] + 0.3) / (n[0] + 0.6))
    return np.where(hits.sum(axis=0) >= 3, odds / 2, 0).astype(F32)


def fit(rows: list[tuple[bytes, int]], seed: int = 5, rounds: int = ROUNDS) -> dict[str, np.ndarray] | None:
    """Parameters from (UTF-8 text, label) rows; None if a label is missing."""
    rng = np.random.default_rng(seed)
    texts = [Text(*inputs(np.frombuffer(b, dtype=np.uint8)), y) for b, y in rows]
    texts = [t for t in texts if len(t.word)]
    if len({t.label for t in texts}) < 2:
        return None
    order = rng.permutation(len(texts))
    back = {int(i) for i in order[: len(texts) // 5]} if len(texts) >= 50 else set()
    held = [t for i, t in enumerate(texts) if i in back]
    learn = [t for i, t in enumerate(texts) if i not in back]
    if len({t.label for t in held}) < 2 or len({t.label for t in learn}) < 2:
        held = learn = texts
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(F32)
    p = {"word": draw(1 << WORD_BITS, DIM, s=0.02), "char": draw(1 << CHAR_BITS, DIM, s=0.02)}
    p["word"][:, 0], p["char"][:, 0] = _odds(learn, 1 << WORD_BITS, "word"), _odds(learn, 1 << CHAR_BITS, "gram")
    for side in "fb":
        p |= {f"in_{side}": draw(DIM, 3 * HIDDEN, s=0.3), f"u_{side}": draw(HIDDEN, 3 * HIDDEN, s=0.3), f"bias_{side}": np.zeros(3 * HIDDEN, dtype=F32)}
        p[f"bias_{side}"][:HIDDEN] = -1
    p |= {"attend": draw(2 * HIDDEN, ATTEND, s=0.3), "query": draw(ATTEND, s=0.3), "out": draw(2 * HIDDEN, s=0.3), "out_bias": np.zeros(1, dtype=F32)}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("word", "char")}
    slow = {k: np.full(len(p[k]), 1e-3, dtype=F32) for k in ("word", "char")}
    step = 0
    for round_ in range(rounds):
        picked: list[tuple[int, int]] = []
        for i, t in enumerate(learn):
            x = vectors(t.word, t.gram, t.many, p)
            index, mask = _windows(len(t.word))
            score = np.where(mask, x[:, 0][index], -9).max(axis=0) if round_ < 2 else logits(t, p, x)
            top = np.argsort(-score, kind="stable")[: 1 if t.label else 3]
            picked += [(i, int(k)) for k in top]
            if not t.label:
                picked += [(i, int(k)) for k in rng.integers(0, len(score), 2)]
        y = np.array([learn[i].label for i, _ in picked], dtype=F32)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1e-6, 1 - y.mean())).astype(F32)
        for _ in range(2):
            for batch in np.array_split(rng.permutation(len(picked)), max(1, len(picked) // 128)):
                parts = [learn[picked[b][0]] for b in batch]
                word, gram, many, index, mask, base = [], [], [], [], [], 0
                for b, t in zip(batch, parts, strict=True):
                    lo = picked[b][1] * STRIDE
                    hi = min(len(t.word), lo + SPAN)
                    ends = np.concatenate([[0], np.cumsum(np.maximum(t.many, 0))])
                    word.append(t.word[lo:hi])
                    many.append(np.maximum(t.many[lo:hi], 0))
                    gram.append(t.gram[ends[lo] : ends[hi]])
                    k = np.arange(SPAN)
                    index.append(base + np.minimum(k, hi - lo - 1))
                    mask.append(k < hi - lo)
                    base += hi - lo
                word, gram, many = np.concatenate(word), np.concatenate(gram), np.concatenate(many)
                index, mask = np.stack(index, axis=1), np.stack(mask, axis=1)
                x, trace = vectors(word, gram, many, p), {}
                z = forward(x, index, mask, p, trace)
                d = (1 / (1 + np.exp(-z)) - y[batch]) * weight[batch] / len(batch)
                g, dx = backward(x, index, p, trace, d.astype(F32))
                step += 1
                for k, v in g.items():
                    a, b = m[k]
                    a += 0.1 * (v - a)
                    b += 0.01 * (v * v - b)
                    p[k] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(F32)
                of = np.repeat(np.arange(len(word)), many)
                for k, at, dv in (("word", word, dx), ("char", gram, dx[of] / many[of, None].astype(F32))):
                    used, place = np.unique(at, return_inverse=True)
                    total = np.zeros((len(used), DIM), dtype=F32)
                    np.add.at(total, place, dv)
                    slow[k][used] += (total * total).mean(axis=1)
                    p[k][used] -= 0.02 * total / np.sqrt(slow[k][used])[:, None]
    # the cut that serves the held-back texts best becomes 0.5
    z = np.array([logits(t, p).max() for t in held])
    y = np.array([t.label for t in held])
    cuts = np.unique(z)
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1e-3]])
    f1 = [2 * (y[z >= c]).sum() / max(1, (z >= c).sum() + y.sum()) for c in cuts]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    p["cut"] = np.array([cuts[best[len(best) // 2]]], dtype=F32)
    return p


def scores(raw: np.ndarray, offsets: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of the texts of a string column, all windows of each."""
    out = np.full(len(offsets) - 1, EMPTY_SCORE)
    for i, j in W.blocks(offsets, 1 << 18):
        start, end, _, at = W.block_words(raw, offsets, i, j)
        first, low, high = [], [], []
        for r in range(j - i):
            f = frames(int(at[r + 1] - at[r])) + at[r]
            first.append(f)
            high.append(np.full(len(f), at[r + 1]))
            low.append(np.full(len(f), r))
        first, high, low = np.concatenate(first), np.concatenate(high), np.concatenate(low)
        best = np.full(j - i, -np.inf)
        for c in range(0, len(first), 4096):
            f, stop = first[c : c + 4096], high[c : c + 4096]
            a, b = int(f[0]), int(min(stop[-1], f[-1] + SPAN))
            # words never touch across texts here: a space stands where one text ends and the next begins
            x = vectors(*_spread(raw, start[a:b], end[a:b]), p)
            index = f[None, :] + np.arange(SPAN)[:, None]
            z = forward(x, np.minimum(index, stop - 1) - a, index < stop, p)
            np.maximum.at(best, low[c : c + 4096], z)
        some = np.isfinite(best)
        out[i:j][some] = 1 / (1 + np.exp(-np.clip(best[some] - p["cut"][0], -30, 30)))
    return out


def _spread(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of the given words, each set apart by a space."""
    size = end - start + 1
    ends = np.cumsum(size)
    index = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
    data = raw[np.minimum(index, len(raw) - 1)]
    data[ends - 1] = 32
    return inputs(data)


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic") -> list[tuple[bytes, int]]:
    """A bounded, deterministic sample of labelled texts outside the held-out fifth.

    Only labels of texts that are there and not empty count towards the bounds.
    """
    learn = labels.where(col(label).isNotNull() & (F.crc32(col(id).cast("string")) % 5 != 0)).select(col(id).alias("_id"), col(label).cast("int").alias("_y"), F.xxhash64(col(id)).alias("_h"))
    texts = docs.select(col(id).alias("_of"), col(text).alias("_t")).where(F.length("_t") > 0)
    learn = learn.join(texts.select("_of"), F.col("_id") == F.col("_of"), "left_semi")
    picked = None
    for y in (0, 1):
        part = learn.where(F.col("_y") == y).orderBy("_h", "_id").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    rows = texts.join(F.broadcast(picked), F.col("_of") == F.col("_id"))
    rows = rows.orderBy("_h", "_id", "_y", "_t").limit(2 * SAMPLE)
    w = Window.partitionBy("_y").orderBy("_h", "_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.octet_length("_t")).over(w)).where(F.col("_sum") <= SAMPLE_BYTES // 2)
    return [(r._t.encode("utf-8", "replace"), r._y) for r in rows.orderBy("_h", "_id", "_y", "_t").select("_t", "_y").collect()]


def score_texts(docs: DataFrame, p: dict[str, np.ndarray] | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: the id and ``score``."""
    kind = docs.schema[id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = W.column_bytes(b.column(1))
            s = scores(raw, offsets, sent.value) if sent.value is not None else np.full(b.num_rows, EMPTY_SCORE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, type=pa.float64())], names=[id, "score"])

    return batched(docs).select(col(id), col(text)).mapInArrow(run, f"`{id}` {kind}, score double")


def op3_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    p = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_texts(docs, p).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity_bigru": op3_toxicity_bigru}
SQL: dict[str, str] = {}
