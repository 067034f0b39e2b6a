"""Intermediate tables in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HELD: ContextVar[list | None] = ContextVar("held", default=None)
BROADCAST_ROWS = 300_000  # rows of a few dozen bytes each: the most that is ever broadcast


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and all runs in one process, an error elsewhere."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return where.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    if (held := _HELD.get()) is not None:
        held.append((fs, where))
    return path


@contextmanager
def released():
    """Remove what is settled inside once the work inside is done."""
    held: list = []
    before = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(before)
        for fs, where in held:
            fs.delete(where, True)


@contextmanager
def configured(spark: SparkSession, key: str, value: object):
    """A setting of the session for the work inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, however often it is read."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(settled: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, marked for broadcast if its counted rows are few."""
    return F.broadcast(settled) if settled.count() <= limit else settled


def given(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds anyway, marked for broadcast if they are few."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
