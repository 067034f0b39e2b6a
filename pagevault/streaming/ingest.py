"""Streams: reading sessions, windowed counts, incremental upserts; those with state of their own are in ``reading``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault.operators.scratch import released
from pagevault.operators.store import keyed, last_id, matching, upsert
from pagevault.streaming.reading import TICK_MS, dwell_stream, offers_stream, once  # noqa: F401  the streams with state


def dwell(ticks: DataFrame, key: str = "user_id", page: str = "event_type", ts: str = "ts", most: int = TICK_MS) -> DataFrame:
    """Batch form: sessions of consecutive ticks on one page, and their focused time.

    Each tick adds the time since the last one, at most ``most``; a change of page resets.
    """
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    t = ticks.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    t = t.withColumn("_new", (~F.lag(page).over(w).eqNullSafe(F.col(page))).cast("int")).withColumn("_gap", F.col("_ms") - F.lag("_ms").over(w))
    t = t.withColumn("session", F.sum("_new").over(w)).withColumn("_add", F.when(F.col("_new") == 1, 0).otherwise(F.least("_gap", F.lit(most))))
    return t.groupBy(key, "session", page).agg(F.count(F.lit(1)).alias("ticks"), F.sum("_add").cast("long").alias("focused_ms"))


def most(ticks: DataFrame, value: str = "value", key: str = "user_id", page: str = "event_type", ts: str = "ts") -> DataFrame:
    """Batch form: the greatest value (scroll depth) of each session of ``dwell``."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    t = ticks.withColumn("_new", (~F.lag(page).over(w).eqNullSafe(F.col(page))).cast("int"))
    t = t.withColumn("session", F.sum("_new").over(w).cast("long"))
    return t.groupBy(key, "session", page).agg(F.max(value).alias("most"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts by type; the watermark bounds state on a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_batches(spark: SparkSession, path: str, stream: str = "batch"):
    """A ``foreachBatch`` sink: each micro-batch is folded into the archive in a new version, which is then published.

    Only the parts that hold pages of the batch, and the one that new ids go to, are
    written; of the others two narrow columns are read, ids and keys.

    Replaying a batch is harmless: its number was published with its rows.  Late pages
    need no watermark, as last seen only grows; dates in the future are the
    sender's to clamp (``operators.store.not_before``).  Give each checkpoint a
    ``stream`` name of its own, as batch numbers start anew with a checkpoint.
    """
    from pagevault.operators import versions as V

    def sink(pages: DataFrame, batch: int) -> None:
        done = V.processed(spark, path, stream)
        if done is not None and batch <= done:
            return
        held = V.current(spark, path)
        pages.persist()  # released with the batch; a lost block is read from the source again
        try:
            parts, top = V.around(spark, path, matching(held, keyed(pages))), last_id(held)
            with released():  # a stream never ends, so what a batch settles goes with it
                V.publish(upsert(V.current(spark, path, parts=parts), pages, top=top), path, f"{stream}-{batch}-{uuid.uuid4().hex[:8]}", parts=parts, batch=(stream, batch))
        finally:
            pages.unpersist()

    return sink
