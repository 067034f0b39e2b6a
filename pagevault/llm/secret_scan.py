"""Secret scan: fixed credential shapes plus dictionary-primed zstandard novelty.

``scan`` gives the spans of one text.  The base kinds are ``assign`` (a
credential name, then ``:`` or ``=``, then a value), ``access`` (access key ids)
and ``hex`` (long lower-case hexadecimal runs).  The method adds ``novel``: a
string near a sensitive cue is compressed with zstandard, primed with a
dictionary made of common code identifiers and of the text around the string;
if its marginal bytes stay near what its alphabet can hold, nothing in its
surroundings predicts it, and it is reported.  Strings that follow a candidate
line by line, and all strings between BEGIN and END marks, are near the cue too.

A string can begin after each of several cues inside one run of characters; all
beginnings are judged, the first incompressible one is reported.  In runs of more
than ``LONG`` bytes the run is compressed once, in pieces between its beginnings,
and a beginning is judged by the sum of the pieces after it: the time stays in
proportion to the run.  A string without a digit, or without a letter, is never
novel: those are words and numbers.

Every text is read whole.  Memory: one Arrow batch, and a few hundred bytes for
each candidate.

Defined results: null text counts as empty and gives no spans; rows are scored
one by one, so repeated rows, ties, empty tables and null ids need no special
care; extra columns of the input are never read; an id may have any name (if it is
called ``spans``, the spans are called ``_spans``).
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm import spans as S
from pagevault.llm.store import batched, beside, col, column, table

KINDS = ("assign", "access", "hex", "novel")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # runs are maximal, so this equals `[0-9a-f]+` with shorter runs dropped
CUES = (b"password", b"passwd", b"passphrase", b"secret", b"token", b"api_key", b"apikey", b"api-key", b"credential",
        b"private key", b"private_key", b"authorization", b"bearer", b"signature", b"client_id", b"webhook", b"-----begin")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.~-]{16,}")
NEXT_LINE = re.compile(rb"[\"',;\\]{0,3}[ \t]*(?:\r?\n|\\n)[ \t]*[\"']?")  # from the end of a candidate to one on the next line
TAIL = re.compile(rb"\s*[A-Za-z0-9+/=]{1,15}(?=\s*-----end)", re.I)  # a short last line before the END mark
BITS = 6  # of a character of the widest alphabet (base64), for which the ratio stands
LEAST_BITS = 4  # of an alphabet with digits and letters
LONG = 4096  # bytes of a run from which it is compressed once for all its beginnings
FRAME = 3  # bytes of a compressed block's header, which a piece would not cost by itself
REACH = 64  # bytes after a cue in which a candidate must begin
AROUND = 256  # bytes of text on either side that prime the dictionary
NOVEL_RATIO = 0.7  # marginal compressed bytes by bytes, from which a string counts as incompressible (less for alphabets of fewer bits)
# Identifiers and phrases that code in general holds; what a text itself says comes from around the string.
IDENTIFIERS = b" ".join((
    b"configuration environment variable application database username password secret token authorization bearer",
    b"client_secret client_id access_token refresh_token private_key public_key api_key apikey signature certificate",
    b"import from return function class const static public private protected string integer boolean null true false",
    b"http https www com org net example localhost index html json yaml config settings default production staging",
    b"getElementById addEventListener innerHTML prototype constructor toString hasOwnProperty document window",
    b"manager factory provider service controller repository handler listener builder adapter interface abstract",
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 placeholder changeme your_token_here xxxxxxxx",
))


def base(data: bytes) -> list[tuple[str, int, int]]:
    """Spans of the three fixed kinds, in bytes, by start and then kind."""
    low = data.lower()
    at = set()
    for name in NAMES:
        i = low.find(name)
        while i >= 0:
            at.add(i)
            i = low.find(name, i + 1)
    out, free = [], 0
    for i in sorted(at):
        if i >= free and (m := ASSIGN.match(data, i)):
            free = m.end()
            if m.end(2) - m.start(2) >= 6:
                out.append(("assign", i, free))
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(data)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def novelty(data: bytes, start: int, end: int, identifiers: bytes = IDENTIFIERS) -> float:
    """Marginal compressed bytes of ``data[start:end]`` by its bytes, given the text around it."""
    prime = identifiers + data[max(0, start - AROUND) : start] + data[end : end + AROUND]
    squeeze = zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False
    )
    return max(0, len(squeeze.compress(data[start:end])) - len(squeeze.compress(b""))) / (end - start)


def alphabet_bits(held: bytes) -> float:
    """Bits a character of the alphabet of a string can hold, marks at its ends left out; ``BITS`` at most."""
    core = held.strip(b"+/_=.~-")
    marks = len(set(core) & set(b"+/_=.~-"))
    letters = re.sub(rb"[^A-Za-z0-9]", b"", core)
    if re.fullmatch(rb"[0-9a-f]*|[0-9A-F]*", letters):
        size = 16
    else:
        size = sum(n for n, x in ((26, rb"[a-z]"), (26, rb"[A-Z]"), (10, rb"[0-9]")) if re.search(x, letters))
    return min(BITS, math.log2(size + marks))


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Strings after a sensitive cue, on adjoining lines or between BEGIN and END marks, by place."""
    low = data.lower()
    cues = [(cue, i + len(cue)) for cue in CUES for i in _places(low, cue)]
    if not cues:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(data)]
    ends = [e for _, e in runs]
    begins = sorted(after for cue, after in cues if cue == b"-----begin")
    found: set[tuple[int, int]] = set()
    for cue, after in cues:
        k = bisect.bisect_right(ends, after)
        near = []
        while k < len(runs) and runs[k][0] <= after + REACH:
            s = max(runs[k][0], after)
            if runs[k][1] - s >= 16:
                near.append((s, k))
            k += 1
        if cue == b"-----begin":
            n = bisect.bisect_right(begins, after)
            stop = low.find(b"-----end", after, begins[n] if n < len(begins) else len(low))
            while stop >= 0 and k < len(runs) and runs[k][0] < stop:
                near.append((runs[k][0], k))
                k += 1
        for s, k in near:
            e = runs[k][1]
            while (s, e) not in found:
                found.add((s, e))
                m = NEXT_LINE.match(data, e)
                if not m or k + 1 == len(runs) or runs[k + 1][0] != m.end():
                    break
                k += 1
                s, e = runs[k]
    return sorted(found)


def _places(low: bytes, cue: bytes) -> Iterator[int]:
    i = low.find(cue)
    while i >= 0:
        yield i
        i = low.find(cue, i + 1)


def _suffixes(data: bytes, starts: list[int], end: int) -> list[float]:
    """``novelty`` of ``data[s:end]`` for rising starts: of one compression, in pieces, the marginal bytes of those after each start."""
    prime = IDENTIFIERS + data[max(0, starts[0] - AROUND) : starts[0]] + data[end : end + AROUND]
    squeeze = zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False
    ).compressobj()
    squeeze.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
    marginal = []
    for a, b in zip(starts, [*starts[1:], end], strict=True):
        size = 0
        for lo in range(a, b, LONG):
            size += max(0, len(squeeze.compress(data[lo : min(b, lo + LONG)])) + len(squeeze.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)) - FRAME)
        marginal.append(size)
    out, total = [], 0
    for s, m in zip(reversed(starts), reversed(marginal), strict=True):
        total += m
        out.append(total / (end - s))
    return out[::-1]


class _Taken:
    """Spans in order, to ask whether a stretch overlaps one."""

    def __init__(self, spans: list[tuple]):
        self.starts = sorted(x[1] for x in spans)
        self.ends = sorted(x[2] for x in spans)

    def meets(self, start: int, end: int) -> bool:
        # spans that begin before its end, less those that end by its start
        return bisect.bisect_left(self.starts, end) > bisect.bisect_right(self.ends, start)


def novel(data: bytes, taken: list[tuple], ratio: float = NOVEL_RATIO) -> list[tuple[str, int, int, float]]:
    """Incompressible strings near a sensitive cue that overlap no span in ``taken``: of those with one end, the longest."""
    out, held_by = [], _Taken(taken)
    for e, group in groupby(sorted(candidates(data), key=lambda x: (x[1], x[0])), key=lambda x: x[1]):
        first = next(group)[0]
        starts = [first, *(s for s, _ in group)]
        run = data[first:e]
        # the last digit and letter tell of every suffix whether it has one
        mixed = first + min(max((m.start() for m in re.finditer(kind, run)), default=-1) for kind in (rb"[0-9]", rb"[A-Za-z]"))
        known = _suffixes(data, starts, e) if e - first > LONG else None
        for k, s in enumerate(starts):
            if s > mixed or held_by.meets(s, e):
                continue
            n = known[k] if known else novelty(data, s, e)
            if n >= ratio * LEAST_BITS / BITS and n >= ratio * alphabet_bits(data[s:e]) / BITS:
                tail = TAIL.match(data, e)
                out.append(("novel", s, tail.end() if tail and not held_by.meets(e, tail.end()) else e, n))
                break
    return sorted(out, key=lambda x: x[1:3])


def scan(text: str | bytes | None, ratio: float = NOVEL_RATIO) -> list[tuple[str, int, int, float]]:
    """All spans of a text (kind, start, end, novelty), in code points, by start and then kind."""
    data = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    fixed = base(data)
    more = novel(data, fixed, ratio)
    found = [(*x, novelty(data, x[1], x[2])) for x in fixed] + more
    return S.code_points(data, sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


def secret_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", ratio: float = NOVEL_RATIO) -> DataFrame:
    """Per row of ``docs``: the id and all spans with their novelty."""
    kind = docs.schema[id].dataType.simpleString()
    (spans,) = beside(id, "spans")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            rows = [[{"kind": k, "start": s, "end": e, "novelty": n} for k, s, e, n in scan(x.as_py(), ratio)] for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, type=arrow)], names=[id, spans])

    return batched(docs).select(col(id).alias("k"), col(text).alias("t")).mapInArrow(run, f"{column(id, kind)}, {spans} {SPANS}")


def op1_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), count("novel").alias("n_novel"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["novelty"])), F.lit(0.0)).alias("max_novelty"),
    )


QUERIES = {"op1_secret_novelty": op1_secret_novelty}
SQL: dict[str, str] = {}
