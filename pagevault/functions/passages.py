"""Passages: snippets, quotes that moved, phrases to quote.

Plain functions of strings (tested without Spark) and their Arrow UDFs.  They
run on a page of results only, never on the corpus.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions.text import fold_term

_WORD = re.compile(r"[^\W_]+")
DOTS = "…"


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Folded words with their bounds; words that fold to nothing or over 64 characters are left out."""
    found = ((fold_term(m.group()), *m.span()) for m in _WORD.finditer(text))
    return [t for t in found if 0 < len(t[0]) <= 64]


def _densest(hits: list[tuple[int, str]], span: int) -> tuple[int, int]:
    """First and last token of the window with most distinct words, then most hits, then earliest."""
    best, held, right = (-1, 0, 0), {}, 0
    for left, (first, word) in enumerate(hits):
        while right < len(hits) and hits[right][0] <= first + span:
            held[hits[right][1]] = held.get(hits[right][1], 0) + 1
            right += 1
        worth = len(held) * 1000 + right - left
        if worth > best[0]:
            best = (worth, first, hits[right - 1][0])
        held[word] -= 1
        if not held[word]:
            del held[word]
    return best[1:]


def snippet(text: str | None, wanted: list[str], most: int = 260, span: int = 40) -> tuple[str, list[tuple[int, int]]]:
    """The densest passage and the ranges of the wanted words in it."""
    if not text:
        return "", []
    want, found = set(wanted), tokens(text)
    hits = [(i, t[0]) for i, t in enumerate(found) if t[0] in want]
    if not hits:
        return text[:most].strip() + (DOTS if len(text) > most else ""), []
    first, last = _densest(hits, span)
    low, high = max(0, first - 8), min(len(found) - 1, last + 8)
    start, end = found[low][1], found[high][2]
    reach = max(0, start - 120)
    stop = text.rfind(". ", reach, start)
    start = stop + 2 if stop >= 0 else start
    stop = text.find(". ", end, end + 120)
    end = stop + 1 if stop >= 0 else end
    end = min(end, start + most)
    shown = text[start:end]
    start += len(shown) - len(shown.lstrip())
    end -= len(shown) - len(shown.rstrip())
    end = max(start, end)
    lead = DOTS if start > 0 else ""
    out = lead + text[start:end]
    if end < len(text) and out[-1:] not in (".", "!", "?"):
        out += DOTS
    return out, [(s - start + len(lead), e - start + len(lead)) for t, s, e in found[low : high + 1] if t in want and s >= start and e <= end]


def _flat(text: str) -> tuple[str, list[int]]:
    """Lower-cased with single spaces, and each character's place in the text."""
    out, place = [], []
    for m in re.finditer(r"\s+|\S", text):
        if m.group().isspace():
            if not out:
                continue
            out.append(" ")
            place.append(m.start())
        else:
            low = m.group().lower()
            out.append(low)
            place += [m.start()] * len(low)
    return "".join(out), place


def locate(page: str | None, quote: str | None, least: int = 4) -> tuple[int, int, str] | None:
    """Where a quote stands: exactly, loosely (case and space), or by its longest surviving opening."""
    if not page or not quote:
        return None
    if (at := page.find(quote)) >= 0:
        return at, at + len(quote), "exact"
    hay, place = _flat(page)
    needle = _flat(quote)[0].strip()
    parts = needle.split(" ") if needle else []
    for n in (len(parts), *range(len(parts) - 1, least - 1, -1)) if parts else ():
        piece = " ".join(parts[:n])
        if (at := hay.find(piece)) >= 0:
            return place[at], place[min(at + len(piece), len(place)) - 1] + 1, "loose" if n == len(parts) else "partial"
    return None


def phrase(shown: str | None, ranges: list[tuple[int, int]] = (), least: int = 4, most: int = 10) -> str | None:
    """Four to ten words to quote, from the first match to the end of its sentence, else from the start."""
    text = re.sub(r"^[…\s]+|[…\s]+$", "", shown or "")
    if not text:
        return None
    at = max(0, ranges[0][0] - shown.startswith(DOTS)) if ranges else 0
    while at > 0 and not (at <= len(text) and text[at - 1].isspace()):
        at -= 1
    sentence = re.split(r"[.!?](?=\s|$)", text[at:], maxsplit=1)[0]
    for piece in (sentence, text):
        picked = piece.split()[:most]
        if len(picked) >= least:
            return " ".join(picked)
    return None


def marked(shown: str, ranges: list[tuple[int, int]]) -> str:
    """HTML with the ranges marked."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    out, at = [], 0
    for s, e in ranges:
        out += [esc(shown[at:s]), "<mark>", esc(shown[s:e]), "</mark>"]
        at = e
    return "".join([*out, esc(shown[at:])])


_SNIPPET = pa.struct([("text", pa.string()), ("ranges", pa.list_(pa.list_(pa.int32())))])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType())))]))
def snippet_udf(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    rows = (snippet(t, w or []) for t, w in zip(texts.to_pylist(), wanted.to_pylist(), strict=True))
    return pa.array([{"text": t, "ranges": [list(r) for r in ranges]} for t, ranges in rows], type=_SNIPPET)


@F.arrow_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("how", T.StringType())]))
def locate_udf(pages: pa.Array, quotes: pa.Array) -> pa.Array:
    rows = (locate(p, q) for p, q in zip(pages.to_pylist(), quotes.to_pylist(), strict=True))
    return pa.array([r and dict(zip(("start", "end", "how"), r, strict=True)) for r in rows], type=pa.struct([("start", pa.int32()), ("end", pa.int32()), ("how", pa.string())]))


@F.arrow_udf(T.StringType())
def phrase_udf(shown: pa.Array, ranges: pa.Array) -> pa.Array:
    return pa.array([phrase(t, r or []) for t, r in zip(shown.to_pylist(), ranges.to_pylist(), strict=True)], type=pa.string())
