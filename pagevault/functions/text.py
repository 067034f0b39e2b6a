"""Text functions as Catalyst expressions: folding, tokens, hashes, sizes, formats.

``fold`` covers every letter whose compatibility decomposition is one base letter
with marks (a table built from the Unicode data by rule), which includes all
Latin, Greek and Cyrillic letters.  ``fold_exact`` is the same for any text, as
an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault import schemas as S

WORD = r"[\p{L}\p{N}]+"
SPLITS = "\u037a"  # a letter that folds to a space


def fold_term(raw: str) -> str:
    """Decompose, drop marks, lower-case, sharp s to ss."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.category(c).startswith("M"))
    return bare.lower().replace("ß", "ss")


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str]:
    """Letters that fold to one other letter, and what to."""
    pairs = [(chr(c), fold_term(chr(c))) for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """``fold_term`` inside the JVM."""
    return F.replace(F.lower(F.translate(c, *_letters())), F.lit("ß"), F.lit("ss"))


@F.arrow_udf(T.StringType())
def fold_exact(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else fold_term(x) for x in c.to_pylist()], type=pa.string())


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def words(c: Column) -> Column:
    """Folded words in order, with duplicates, those too long to be terms included.

    The text is folded at once: letters fold to letters, all but one (``SPLITS``), so words begin and end at the same places.
    """
    whole = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(fold(c))
    return F.when(c.contains(SPLITS), F.transform(_words(c), fold)).otherwise(_words(whole))


def terms(c: Column) -> Column:
    """Folded words in order, with duplicates; positions are kept by dropped words (null entries)."""
    return F.transform(words(c), lambda t: F.when((t != "") & (F.length(t) <= S.TERM_CHARS), t))


def count_terms(c: Column) -> Column:
    """How many ``terms`` aren't null; only words that can be too long are folded."""
    return F.size(F.filter(_words(c), lambda t: (F.octet_length(t) <= S.TERM_CHARS // 2) | (F.length(fold(t)) <= S.TERM_CHARS)))


def indexed_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def variants(t: Column) -> Column:
    """Singulars to try, in order."""
    return F.array_compact(F.array(
        F.when((F.length(t) >= 5) & t.endswith("es"), F.left(t, F.length(t) - 2)),
        F.when((F.length(t) >= 4) & t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)),
    ))


SEEDS = (0x811C9DC5, 0x9E3779B9)


def fnv_hashes(texts: Sequence[str]) -> list[str]:
    """Two 32-bit FNV-1a hashes over the UTF-16 units of each text, in hexadecimal: unit by unit, over all texts that go on."""
    raw = [x.encode("utf-16-le", "surrogatepass") for x in texts]
    n = np.array([len(x) // 2 for x in raw], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    units, start = np.frombuffer(b"".join(raw[k] for k in order), dtype="<u2"), np.cumsum(n[order]) - n[order]
    h = np.tile(np.array(SEEDS, dtype=np.uint32)[:, None], len(raw))
    left = len(raw) - np.searchsorted(n[order][::-1], np.arange(n.max(initial=0)), side="right")  # texts longer than that
    for i, k in enumerate(left.tolist()):
        part = h[:, :k]
        part ^= units[start[:k] + i].astype(np.uint32)
        part *= np.uint32(0x01000193)
    out = [""] * len(raw)
    for k, a, b in zip(order.tolist(), *h.tolist(), strict=True):
        out[k] = f"{a:08x}{b:08x}"
    return out


@F.arrow_udf(T.StringType())
def content_hash(c: pa.Array) -> pa.Array:
    """``fnv_hashes`` of a column; null stays null."""
    held = fnv_hashes(c.drop_null().to_pylist())
    rest = iter(held)
    return pa.array([next(rest) if v else None for v in c.is_valid().to_pylist()], type=pa.string())


def byte_length(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit("")))


def excerpt(c: Column) -> Column:
    return F.left(c, F.lit(S.EXCERPT))


def truncate_utf8(text: str | None, limit: int) -> str | None:
    """At most so many bytes of UTF-8, never part of a character."""
    return None if text is None else text.encode()[:limit].decode(errors="ignore")


def truncated(c: Column, limit: int = S.TEXT_BYTES) -> Column:
    """``truncate_utf8`` as a column; only texts over the limit are cut in Python."""

    @F.arrow_udf("string")
    def cut(x: pa.Array) -> pa.Array:
        return pa.array([truncate_utf8(t, limit) for t in x.to_pylist()], type=pa.string())

    return F.when(F.octet_length(c) <= limit, c).otherwise(cut(F.when(F.octet_length(c) > limit, c)))


def idf(df: Column, docs: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def term_score(tf: Column, idf_: Column, length: Column, mean: Column) -> Column:
    long = F.when(F.coalesce(length, F.lit(0)) == 0, 1).otherwise(length)
    avg = F.when(mean == 0, 1.0).otherwise(mean)
    return idf_ * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * long / avg))


def recency(last_seen: Column, now: int) -> Column:
    days = (F.lit(now) - F.coalesce(last_seen, F.lit(now))) / S.DAY_MS
    return 1 + S.RECENCY / F.log2(F.greatest(F.lit(0.0), days) + 4)


def one_decimal(x: Column) -> Column:
    """A number that isn't negative with one decimal; of two equally near the one with the even digit, as C's printf has it."""
    tenths = (F.floor(x) * 10 + F.rint((x - F.floor(x)) * 10)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def size_text(n: Column) -> Column:
    """Bytes for people: B, KB, MB, GB, each handing over before it would round up to the next."""
    n = F.coalesce(n, F.lit(0))
    kb, mb, gb = F.floor(n / 1024 + 0.5), n / 1048576, n / 1073741824
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when((n < 1048576) & (kb < 1024), F.concat(kb.cast("string"), F.lit("KB")))
        .when((n < 10485760) & (mb < 9.95), F.concat(one_decimal(mb), F.lit("MB")))
        .when((n < 1073741824) & (F.floor(mb + 0.5) < 1024), F.concat(F.floor(mb + 0.5).cast("string"), F.lit("MB")))
        .otherwise(F.concat(one_decimal(gb), F.lit("GB")))
    )


def when_text(at: Column, now: Column) -> Column:
    """Calendar distance in words (both timestamps, session time zone)."""
    d = F.datediff(F.to_date(now), F.to_date(at))
    months, years = F.floor(d / 30 + 0.5), F.floor(d / 365 + 0.5)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(d.isNull(), "").when(d <= 0, "today").when(d == 1, "yesterday").when(d < 30, say(d, "days"))
        .when(d < 365, F.when(months == 1, "last month").otherwise(say(months, "months")))
        .otherwise(F.when(years == 1, "last year").otherwise(say(years, "years")))
    )


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def pages_for(n: Column) -> Column:
    """About how many pages fit in so many bytes, rounded for people, with thousands separators."""
    pages = n / F.lit(float(S.PAGE_BYTES_ESTIMATE))
    to = lambda step: F.floor(pages / step + 0.5) * step
    return F.format_number(F.when(pages < 1000, F.greatest(F.lit(1), to(10))).when(pages < 100_000, to(1000)).otherwise(to(100_000)), 0)


def describe_size(n: Column) -> Column:
    """A size limit in words: whole megabytes, from a gigabyte on gigabytes with at most one decimal."""
    gb, mb = 1024**3, 1024**2
    whole = F.concat(F.floor(n / gb).cast("string"), F.lit("GB"))
    return F.when(n < gb, F.concat(F.floor(n / mb + 0.5).cast("string"), F.lit("MB"))).when(n % gb == 0, whole).otherwise(F.concat(one_decimal(n / F.lit(float(gb))), F.lit("GB")))
