"""A versioned table directory: write a new version, check it, then publish it under the next number.

There is no MERGE without a table format on the class path, so a change is a new
version.  Rows lie in parts by ranges of ids; a version writes the parts that it
changes, and its list of parts names for all others the version that wrote them,
so that a change costs what it touches, not the whole table.  A version is
published by a pointer file whose name is a
number that has never been used; pointers are never replaced, so whatever step a
writer dies at, readers see the last version that was published whole.  A folder
that holds versions but no pointer is refused rather than taken for empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.schemas import ARCHIVE

FORMAT = 1
EMPTY = "-"  # the version that the first pointer names
PART_BITS = 20  # a part holds the ids that are equal but for so many low bits; the list of parts stays short


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


class Journal:
    """Small texts under rising numbers in one folder; the newest counts, none is ever replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def read(self, number: int) -> str:
        return _text(self.spark, f"{self.path}/{number:012d}")

    def newest(self) -> str | None:
        held = self.numbers()
        return self.read(held[-1]) if held else None

    def append(self, text: str, after: int | None = None) -> int:
        """Write the next number; with ``after`` it must still be the newest, or another writer was faster."""
        held = self.numbers()
        last = held[-1] if held else 0
        if after is not None and last != after:
            raise OSError(f"{self.path} has moved on from {after} to {last}")
        fs, to = file_system(self.spark, f"{self.path}/{last + 1:012d}")
        _, new = file_system(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        _create(self.spark, new.toString(), text)
        if fs.exists(to) or not fs.rename(new, to):
            fs.delete(new, False)
            raise OSError(f"{to} was written by another writer")
        return last + 1

    def forget(self, keep: int) -> None:
        for n in self.numbers()[:-keep]:
            fs, p = file_system(self.spark, f"{self.path}/{n:012d}")
            fs.delete(p, False)


def pointers(spark: SparkSession, path: str) -> Journal:
    return Journal(spark, f"{path}/pointers")


def _split(text: str) -> tuple[int, str]:
    form, version = text.split("\t")[:2]
    return int(form), version


def _streams(text: str | None) -> dict[str, int]:
    """The newest batch of each stream that a pointer knows of."""
    said = (text or "").split("\t")
    return json.loads(said[2]) if len(said) > 2 else {}


def processed(spark: SparkSession, path: str, stream: str) -> int | None:
    """The newest batch of a stream that was published.

    It stands in the newest pointer, which each change hands on, so that it is
    published with the batch's rows or not at all, and no vacuum forgets it.
    """
    return _streams(pointers(spark, path).newest()).get(stream)


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return [n for n in names if n != "pointers" and fs.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1])]


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(format, version) of the newest pointer; None for a folder that nothing was ever published in."""
    text = pointers(spark, path).newest()
    if text is not None:
        return _split(text)
    held = _versions(spark, path)
    if held:
        raise ValueError(f"{path} holds versions ({', '.join(sorted(held)[:3])}) but no pointer; nothing has been changed")
    return None


def part_of(id: Column) -> Column:
    """The part of an id; all null ids are in one part."""
    return F.coalesce(F.shiftright(id, PART_BITS), F.lit(-1))


def parts_of(ids: DataFrame) -> list[int]:
    """The parts of a table's ids: one number for each 2 ** ``PART_BITS`` ids at most."""
    return sorted(r[0] for r in ids.select(part_of(F.col("id"))).distinct().collect())


def around(spark: SparkSession, path: str, ids: DataFrame) -> list[int]:
    """The parts of the ids, and the one that the next id belongs to: all that a change of these pages and new ones can touch."""
    held = current(spark, path)
    after = held.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    return sorted({*parts_of(ids), *parts_of(after)})


def part_list(spark: SparkSession, path: str, version: str) -> dict[int, str] | None:
    """The version that wrote each part of a version; None for a version that was written in one piece."""
    if version == EMPTY:
        return {}
    fs, p = file_system(spark, f"{path}/{version}/_parts")
    if not fs.exists(p):
        return None
    return {int(k): v for k, v in json.loads(_text(spark, f"{path}/{version}/_parts")).items()}


def current(spark: SparkSession, path: str, schema=ARCHIVE, parts: Iterable[int] | None = None) -> DataFrame:
    """The current version, or some of its parts; an empty table if nothing was published yet.  A newer format is refused."""
    held = current_version(spark, path)
    if held is not None and held[0] > FORMAT:
        raise ValueError(f"the archive has format {held[0]}; this code reads up to {FORMAT}")
    return spark.createDataFrame([], schema) if held is None else _read(spark, path, held[1], schema, parts)


def _read(spark: SparkSession, path: str, version: str, schema=ARCHIVE, parts: Iterable[int] | None = None) -> DataFrame:
    listed = part_list(spark, path, version)
    if listed is None:
        whole = spark.read.parquet(f"{path}/{version}")
        return whole if parts is None else whole.where(part_of(F.col("id")).isin(*parts))
    some = {p: v for p, v in listed.items() if parts is None or p in set(parts)}
    return _folders(spark, path, some) if some else spark.createDataFrame([], schema)


def _folders(spark: SparkSession, path: str, parts: dict[int, str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{v}/_part={p}" for p, v in sorted(parts.items())])


def publish(table: DataFrame, path: str, version: str, key: str = "url_key", form: int = FORMAT, parts: Iterable[int] | None = None, batch: tuple[str, int] | None = None) -> None:
    """Write a version, count it back, and point to it.

    With ``parts`` the table replaces those parts only (and may hold new ones); all
    others stay as they are in the current version.  ``batch`` is the stream and the
    number of the micro-batch that the version holds.  A name whose folder exists is
    refused: a later version may read what is there.
    """
    spark = table.sparkSession
    journal = pointers(spark, path)
    held = current_version(spark, path)
    if held is None:
        journal.append(f"{form}\t{EMPTY}", 0)
        held = form, EMPTY
    fs, where = file_system(spark, f"{path}/{version}")
    if fs.exists(where):
        raise ValueError(f"version {version} was written before")
    after = journal.numbers()[-1]
    streams = _streams(journal.read(after)) | dict([batch] if batch else [])
    before = part_list(spark, path, held[1]) if parts is not None else {}
    if before is None:
        raise ValueError(f"version {held[1]} was written in one piece; publish the whole table once")
    # tasks of even size, of one part each where parts are large; small parts share a task
    table.withColumn("_part", part_of(F.col("id"))).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path}/{version}")
    written = parts_in(spark, f"{path}/{version}")
    stay = {p: v for p, v in before.items() if p not in set(parts or ())}
    if both := sorted(stay.keys() & set(written)):
        raise ValueError(f"the new version holds rows of parts {both[:3]}, which it was not to replace")
    _create(spark, f"{path}/{version}/_parts", json.dumps(stay | dict.fromkeys(written, version)))
    if written:
        new = spark.read.parquet(f"{path}/{version}")
        n, keys = new.selectExpr("count(*)", f"count(distinct {key})").first()
        if n != keys:
            raise ValueError("a key stands twice in the new version")
        if stay and not _folders(spark, path, stay).select(key).join(new.select(key), key, "left_semi").isEmpty():
            raise ValueError("a key of the new version stands in a part that stays")
    journal.append("\t".join([str(form), version, *([json.dumps(streams)] if streams else [])]), after)


def needed(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """(version, part) of everything that a kept pointer names."""
    journal = pointers(spark, path)
    named = {_split(journal.read(n))[1] for n in journal.numbers()}
    return {(v, p) for x in named for p, v in (part_list(spark, path, x) or {}).items()}


def parts_in(spark: SparkSession, folder: str) -> list[int]:
    """The parts that a folder holds files of; none for a folder that isn't there."""
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return [int(n.removeprefix("_part=")) for n in names if n.startswith("_part=")]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all versions and parts but those that the newest ``keep`` pointers need; the names of removed versions come back."""
    journal = pointers(spark, path)
    numbers = journal.numbers()
    named = {_split(journal.read(n))[1] for n in numbers[-keep:]}
    lists = {v: part_list(spark, path, v) for v in named}
    needed = {(v, p) for x in lists.values() for p, v in (x or {}).items()}
    stay = named | {v for v, _ in needed}
    gone = [v for v in _versions(spark, path) if v not in stay] if numbers else []
    journal.forget(keep)
    dead = [f"{v}/_part={p}" for v in stay - {EMPTY} for p in parts_in(spark, f"{path}/{v}") if (v, p) not in needed] if numbers else []
    for v in [*gone, *dead]:
        fs, p = file_system(spark, f"{path}/{v}")
        fs.delete(p, True)
    return gone


@dataclass(frozen=True)
class Migration:
    """To a format from the one before: the same rows, by id, in another shape."""

    form: int
    describe: str
    run: Callable[[DataFrame], DataFrame]


def upgrade(spark: SparkSession, path: str, migrations: Sequence[Migration] = (), form: int = FORMAT) -> list[str]:
    """Bring the archive to a format, one published version a migration; what was applied comes back.

    A migration must keep every id, and the old version stays readable until its
    successor is published.
    """
    held = current_version(spark, path)
    if held is None:
        return []
    if held[0] > form:
        raise ValueError(f"the archive has format {held[0]}; this code reads up to {form}. Nothing has been changed")
    done = []
    for m in sorted(migrations, key=lambda m: m.form):
        if not held[0] < m.form <= form:
            continue
        if held[1] == EMPTY:
            journal = pointers(spark, path)
            journal.append("\t".join([str(m.form), EMPTY, *(journal.newest() or "").split("\t")[2:]]))
        else:
            old = _read(spark, path, held[1])
            new = m.run(old)
            lost = old.select("id").exceptAll(new.select("id")).count(), new.select("id").exceptAll(old.select("id")).count()
            if any(lost):
                raise ValueError(f"the migration to format {m.form} would lose {lost[0]} and add {lost[1]} pages")
            publish(new, path, f"{held[1]}-format{m.form}-{uuid.uuid4().hex[:8]}", form=m.form)
        held = current_version(spark, path)
        done.append(m.describe)
    return done
