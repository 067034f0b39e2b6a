"""The dictionary of a changing archive, as runs of changes that are merged by levels.

A state names the parts of the archive it describes and the runs whose sums are
its document frequencies.  When parts change, one new run holds, for each word
whose frequency they change, the difference (a word that is gone sums to zero: that
is its tombstone).  Once ``FAN`` runs stand on a level they are merged into one of the
next, so a word is written once a level, a change writes the words it changes,
and a reader meets ``FAN`` runs a level at most.  States are numbered and never replaced;
a writer that dies leaves the last state, and files that ``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.operators.versions import Journal, file_system

FAN = 4
SCHEMA = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
Terms = Callable[[dict[int, str]], DataFrame | None]  # words of parts (term, df), rows of several parts side by side; None if they are not all there


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("df").cast("long").alias("df"))


class Dictionary:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.journal = spark, path, Journal(spark, f"{path}/states")

    def state(self) -> dict | None:
        """``parts`` (part to version) and ``runs`` (level, name) of the newest state."""
        text = self.journal.newest()
        if text is None:
            return None
        held = json.loads(text)
        return {"parts": {int(k): v for k, v in held["parts"].items()}, "runs": [tuple(r) for r in held["runs"]]}

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        rows.where("df != 0").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/{name}")
        return name

    def _rows(self, runs: list[tuple[int, str]]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{name}" for _, name in runs]) if runs else self.spark.createDataFrame([], SCHEMA)

    def follow(self, parts: dict[int, str], terms: Terms) -> list[tuple[int, str]]:
        """Runs that describe an archive of these parts; what is new since the newest state is written first."""
        numbers = self.journal.numbers()
        held = self.state()
        if held and held["parts"] == parts:
            return held["runs"]
        change = self._change(held["parts"], parts, terms) if held else None
        if change is None:  # the first state, or words of replaced parts are gone
            whole = terms(parts)
            if whole is None:
                raise ValueError("the words of a part of the archive are missing")
            level, size = 0, max(1, len(parts))
            while FAN**level < size:
                level += 1
            runs = [(level, self._write(_summed(whole)))]
        else:
            runs = [*held["runs"], (0, self._write(_summed(change)))]
            while full := [n for n in {x for x, _ in runs} if sum(x == n for x, _ in runs) >= FAN]:
                level = min(full)
                old = [r for r in runs if r[0] == level]
                runs = [r for r in runs if r[0] != level] + [(level + 1, self._write(_summed(self._rows(old))))]
        self.journal.append(json.dumps({"parts": parts, "runs": runs}), numbers[-1] if numbers else 0)
        return runs

    @staticmethod
    def _change(old: dict[int, str], new: dict[int, str], terms: Terms) -> DataFrame | None:
        """Words of parts that came (counted) and of parts that went (counted off)."""
        came = terms({p: v for p, v in new.items() if old.get(p) != v})
        went = terms({p: v for p, v in old.items() if new.get(p) != v})
        return None if came is None or went is None else reduce(DataFrame.unionByName, (came, went.withColumn("df", -F.col("df"))))

    def load(self, parts: dict[int, str], terms: Terms) -> DataFrame:
        """(term, df) of an archive of these parts; filters on the term reach the files of each run."""
        return _summed(self._rows(self.follow(parts, terms))).where("df > 0")

    def vacuum(self) -> list[str]:
        """Remove the runs that the newest state doesn't name; no reader may be at an older one."""
        fs, p = file_system(self.spark, self.path)
        held = self.state()
        if held is None:
            return []
        kept = {name for _, name in held["runs"]}
        gone = [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("run-") and n not in kept]
        for name in gone:
            fs.delete(file_system(self.spark, f"{self.path}/{name}")[1], True)
        self.journal.forget(1)
        return gone
