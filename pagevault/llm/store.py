"""Reading the input tables and settling intermediate ones where all executors see them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 300_000  # rows of a few dozen bytes each: the most that is ever broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader (any file system)."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a session in one process gets a temporary folder; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return where.rstrip("/")


# Bounds on what a task holds at once, set in the session by every operator.
BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",  # not 10,000 rows of text
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",  # not 64 MB
    "parquet.block.size": str(32 << 20),  # a writer buffers a row group, a reader its column chunks
    "parquet.hadoop.vectored.io.enabled": "false",  # its threads keep direct buffers as large as the chunks they read
}


def bounded(spark: SparkSession) -> None:
    for key, value in BOUNDS.items():
        spark.conf.set(key, value)


def batched(df: DataFrame) -> DataFrame:
    """The same table, once the session's bounds hold."""
    bounded(df.sparkSession)
    return df


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a recomputation) and
    lets the planner know the table's true size.  Removed by ``discard``, or when
    the driver ends.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that no later plan reads."""
    for t in tables:
        fs, where = _folder(t.sparkSession, t._settled)
        fs.delete(where, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """The same settled table, marked for broadcast only if its counted rows (or summed weights) are few.

    Beyond the limit it comes back unmarked and the join shuffles (AQE splits skewed keys).
    """
    return F.broadcast(df) if is_small(df, limit, weight) else df


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> bool:
    return (df.agg(F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0] or 0) <= limit


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that none of the table's columns has."""
    held = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def beside(id: str, *names: str) -> list[str]:
    """Names of result columns that stand beside an id column; one that the id has already gets an underscore."""
    return ["_" + n if n.lower() == id.lower() else n for n in names]


def column(name: str, kind: str) -> str:
    """A column in a schema text, whatever characters its name holds."""
    return "`" + name.replace("`", "``") + "` " + kind


def others(docs: DataFrame, *results: str) -> list[str]:
    """The table's columns but for those that carry the name of a result column: the result takes their place."""
    return [c for c in docs.columns if c.lower() not in {r.lower() for r in results}]


def content(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)
