"""Archive exports: one JSON object a line with a header beside them, and the single-document form."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions import text as X
from pagevault.operators.versions import file_system
from pagevault.schemas import EXPORT_FORMAT

PAGE = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("firstSeen", T.StringType()),
    T.StructField("lastSeen", T.StringType()), T.StructField("visitCount", T.IntegerType()), T.StructField("pinned", T.BooleanType()), T.StructField("text", T.StringType()),
])
BAD = "_bad"


def rows(archive: DataFrame) -> DataFrame:
    return archive.select("url", "title", "domain", X.iso(F.col("first_seen")).alias("firstSeen"), X.iso(F.col("last_seen")).alias("lastSeen"), F.col("visit_count").alias("visitCount"), "pinned", "text")


def header(total: int, at: str, settings: dict | None = None) -> dict:
    return {"format": EXPORT_FORMAT, "version": 1, "exportedAt": at, "total": total, "settings": settings or {}}


def write(archive: DataFrame, path: str, at: str | None = None, settings: dict | None = None) -> dict:
    """Pages as lines of JSON in ``path``, and the header, which comes back, in its ``_header.json``, which readers of the lines skip."""
    rows(archive).write.mode("overwrite").json(path)
    head = header(archive.count(), at or _now(), settings)
    _write_text(archive.sparkSession, f"{path}/_header.json", [json.dumps(head)])
    return head


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def write_document(archive: DataFrame, path: str, at: str | None = None, settings: dict | None = None) -> dict:
    """One JSON document with all pages by id; the driver passes lines on and never holds more than one partition of them."""
    head = header(archive.count(), at or _now(), settings)
    lines = archive.repartitionByRange("id").sortWithinPartitions("id").transform(rows).select(F.to_json(F.struct("*")).alias("line"))

    def parts() -> Iterator[str]:
        yield json.dumps(head)[:-1] + ', "pages": ['
        first = True
        for r in lines.toLocalIterator():
            yield ("\n" if first else ",\n") + r.line
            first = False
        yield "\n]}"

    _write_text(archive.sparkSession, path, parts())
    return head


def _write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def _pages(raw: DataFrame) -> DataFrame:
    return raw.select("url", "title", "text", X.from_iso(F.col("lastSeen")).alias("last_seen"), "pinned", X.from_iso(F.col("firstSeen")).alias("first_seen"), F.when(F.col("visitCount") > 0, F.col("visitCount")).alias("visit_count"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, bad lines) of a line-by-line export."""
    schema = T.StructType([*PAGE.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("p"))
    whole = F.col(f"p.{BAD}").isNull() & F.col("p").isNotNull()
    return _pages(raw.where(whole).select("p.*")), raw.where(~whole).select(F.col("value").alias("line"))


_MARK = re.compile(r'["{}\[\]:,]')
_STRING_END = re.compile(r'["\\]')


def events(chunks: Iterable[str]) -> Iterator[tuple[str, object]]:
    """What a document's text holds, as it arrives: ("format", name), ("page", object), ("bad", its text), ("truncated", None).

    Only the top-level keys ``format`` and ``pages`` count.  Only the page being
    read is held; what came before it is dropped.
    """
    stack: list[str] = []
    held, at = "", 0  # text not yet done with, and where to go on in it
    page = -1  # where in ``held`` the page being read begins
    string = -1  # where in ``held`` the open string begins
    key = last = None  # the top-level key whose value is open, and the last string at the top
    pages = False
    for chunk in chunks:
        held += chunk
        while True:
            m = (_STRING_END if string >= 0 else _MARK).search(held, at)
            if not m:
                at = len(held)
                break
            c, at = m.group(), m.end()
            if string >= 0:
                if c == "\\":
                    if at >= len(held):  # the escaped character comes with the next chunk
                        at -= 1
                        break
                    at += 1
                    continue
                if len(stack) == 1:
                    try:
                        last = json.loads(held[string:at])
                    except ValueError:
                        last = None
                    if key == "format":
                        yield "format", last
                string = -1
            elif c == '"':
                string = m.start()
            elif c in "{[":
                if len(stack) == 1 and c == "[" and key == "pages":
                    pages = True
                elif pages and len(stack) == 2 and c == "{":
                    page = m.start()
                stack.append(c)
            elif c in "}]":
                if stack:
                    stack.pop()
                if page >= 0 and len(stack) == 2:
                    try:
                        yield "page", json.loads(held[page:at])
                    except ValueError:
                        yield "bad", held[page:at]
                    page = -1
                pages = pages and len(stack) > 1
            elif len(stack) == 1:
                key = last if c == ":" else None
        keep = min([x for x in (page, string) if x >= 0], default=at)
        held, at = held[keep:], at - keep
        page, string = (x - keep if x >= 0 else -1 for x in (page, string))
    if stack or string >= 0:
        yield "truncated", None


CHUNK = 1 << 20


def document_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, page, bad) of single-document exports: kinds format, page, bad and truncated, one task a document.

    ``page`` is null but for pages; of a cut document all pages before the cut come.
    """
    names = [f.name for f in PAGE.fields]

    def clean(page: dict) -> str:
        return json.dumps({k: page.get(k) for k in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = content.decode("utf-8", "replace")
                out: list[tuple] = []
                for kind, value in events(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)):
                    fine = kind == "page" and isinstance(value, dict)
                    out.append((file, kind, clean(value) if fine else str(value) if kind == "format" else None, value if kind == "bad" else None))
                    if len(out) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in zip(*out, strict=True)], names=["file", "kind", "value", "bad"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in zip(*out, strict=True)], names=["file", "kind", "value", "bad"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "file string, kind string, value string, bad string")
    return found.select("file", "kind", F.when(F.col("kind") == "format", F.col("value")).alias("format"), F.when(F.col("kind") == "page", F.from_json("value", PAGE)).alias("page"), "bad")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Pages of single-document exports, also of cut ones; only the top-level ``pages`` counts."""
    return _pages(document_events(spark, path).where("kind = 'page'").select("page.*"))
