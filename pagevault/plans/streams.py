"""Streaming-shaped queries, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault.plans import corpus as C
from pagevault.streaming import ingest as T


def dwell_sessions(s, d):
    e = C.table(s, d, "events")
    return T.dwell(e).select("user_id", F.col("session").cast("long").alias("session"), "event_type", "ticks", "focused_ms")


def tumbling_counts(s, d):
    e = C.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = T.windowed(e, "1 day")
    return w.select(F.unix_millis("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_counts(s, d):
    e = C.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.windowed(e, "2 days", "1 day").select(F.unix_millis("start").alias("start"), "event_type", "n")


def session_windows(s, d):
    e = C.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.sessions(e, "6 hours").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


QUERIES = {f.__name__: f for f in (dwell_sessions, tumbling_counts, sliding_counts, session_windows)}
SQL = {
    "dwell_sessions": """WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000 AS ms, ts FROM events), f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new, ms - lag(ms) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM f)
 SELECT user_id, session::BIGINT AS session, event_type, count(*) AS ticks, sum(CASE WHEN new = 1 THEN 0 ELSE least(gap, 3000) END)::BIGINT AS focused_ms FROM g GROUP BY user_id, session, event_type""",
    "tumbling_counts": "SELECT epoch_ms(date_trunc('day', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT epoch_ms(d) AS start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS d, event_type FROM events) GROUP BY 1, 2",
    "session_windows": """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
 SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 21600000000 AS end, count(*) AS n FROM g GROUP BY user_id, k""",
}
