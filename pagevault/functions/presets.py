"""Exclusion bundles: named groups of rules that are switched as one.

The rules of a bundle are data, kept as a table (bundle, rule) and given as a
parameter; without one a bundle has only the rules named here.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagevault.functions.rules import PRIVATE

# The bundles' names.
BUNDLES = ("webmail", "messaging", "aiChats", "accounts", "banking", "health", "adult", "dating", "government", "intranet", "workTools", "searchResults")
BUILT_IN: Mapping[str, tuple[str, ...]] = {"intranet": (PRIVATE,), "webmail": ("webmail.*",)}


def read(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Bundles from a table (bundle, rule) in Parquet, JSON lines or CSV with a header, by the path's ending."""
    form = "json" if path.endswith((".json", ".jsonl")) else "csv" if path.endswith(".csv") else "parquet"
    rows = spark.read.format(form).options(**({"header": "true"} if form == "csv" else {})).load(path)
    held = rows.where(F.col("bundle").isNotNull() & F.col("rule").isNotNull()).groupBy("bundle").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    return {r.bundle: tuple(r.rules) for r in held.collect()}  # a list that people keep by hand


def rules_for(on: object, custom: object = (), bundles: Mapping[str, Iterable[str]] | None = None) -> list[str]:
    """Rules of the bundles that are on, then the custom ones; unknown bundles and anything but text are ignored."""
    held = BUILT_IN if bundles is None else bundles
    out = [r for name, yes in (on.items() if isinstance(on, Mapping) else ()) if yes for r in held.get(name, ())]
    return out + [r for r in (custom if isinstance(custom, (list, tuple)) else ()) if isinstance(r, str) and r]
