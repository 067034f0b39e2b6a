"""Exclusion rules as a table: any number of them, joined with pages by host key.

``functions.rules`` writes rules into an expression, which suits what a person types.
Bundles and imported lists hold thousands: here a rule is a row under its host key
(``compiled``), a page has a few keys (its host's labels from either end), and the two
meet in an equi-join, so a plan has the same size for ten rules and a million.  Tests of
paths follow the join, on rules of the page's own host only.

Scale: rules are broadcast if they are counted as few; otherwise pages' keys (not
their rows) are shuffled, distinct by host first, so that a host with a third of all
pages is one row.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions import rules as R
from pagevault.functions import urls as U
from pagevault.operators.scratch import settle, small

_ROW = T.StructType([T.StructField("key", T.StringType()), T.StructField("starts", T.StringType()), T.StructField("equals", T.ArrayType(T.StringType()))])


def _row(rule: str | None) -> dict | None:
    r = R.compiled(rule or "")
    return r and {"key": r.key, "starts": r.starts, "equals": list(r.equals) or None}


@F.arrow_udf(_ROW)
def _compiled(rules: pa.Array) -> pa.Array:
    return pa.array([_row(x) for x in rules.to_pylist()], type=pa.struct([("key", pa.string()), ("starts", pa.string()), ("equals", pa.list_(pa.string()))]))


def compiled(rules: DataFrame) -> DataFrame:
    """A table of rules as they were written (``rule``), as settled rows by key; rules that cover nothing are left out."""
    rows = rules.select("rule").where("rule IS NOT NULL").distinct().withColumn("r", _compiled("rule"))
    return settle(rows.where("r IS NOT NULL").select("rule", "r.key", "r.starts", "r.equals"), "rules")


def of(spark: SparkSession, rules: Iterable[str]) -> DataFrame:
    return compiled(spark.createDataFrame([(r,) for r in rules], "rule string"))


def covered(pages: DataFrame, rules: DataFrame, id: str = "id", url: str = "url") -> DataFrame:
    """(id, rule) of every page and ``compiled`` rule that covers it, each pair once for each row of the page."""
    host = R.host_of(F.col(url))
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), F.lower(U.path(F.col(url))).alias("path")).where("host IS NOT NULL")
    hosts = rows.select("host").distinct().withColumn("key", F.explode(F.array_distinct(R.host_keys(F.col("host")))))
    met = settle(hosts.join(small(rules), "key").select("host", "rule", "starts", "equals"), "hosts")
    on = F.when(F.col("starts").isNull() & F.col("equals").isNull(), True).otherwise(F.coalesce(F.col("path").startswith(F.col("starts")), F.lit(False)) | F.coalesce(F.array_contains("equals", F.col("path")), F.lit(False)))
    return rows.join(small(met), "host").where(on).select(F.col("id").alias(id), "rule")


def excluded(pages: DataFrame, rules: DataFrame, id: str = "id", url: str = "url") -> DataFrame:
    """The pages that any rule covers: ``id`` and the first of their rules in order."""
    return covered(pages, rules, id, url).groupBy(id).agg(F.min("rule").alias("rule"))
