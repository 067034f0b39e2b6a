"""The storage budget: eviction, log, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault.operators import retention as R
from pagevault.operators import store as O
from pagevault.plans import corpus as C

MONTHS = 0.94  # about 28.6 days: some pages are older than that before NOW
CAP = 3_000_000
AGES = {"eviction_age": (MONTHS, 10**12), "eviction_size": (12, CAP), "eviction_both": (0.99, CAP)}


def _plan(name: str):
    def query(s, d):
        return R.plan(C.sized(s, d), C.NOW, *AGES[name]).select("id", "bytes", "reason")

    return query


def eviction_summary(s, d):
    return R.summary(R.plan(C.sized(s, d), C.NOW, *AGES["eviction_both"])).select("bytes_freed", "age", "size", "reason")


def budget(s, d):
    o = R.overview(C.sized(s, d), C.NOW, 10 * CAP)
    return o.select("pages", "pinned", "bytes", F.round("fraction", 6).alias("fraction"), "level", F.round("bytes_per_day", 3).alias("bytes_per_day"), F.col("days_observed").cast("long").alias("days_observed"), F.round("exhausts_at", 0).alias("exhausts_at"))


def log_merge(s, d):
    e = C.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 400_000 + F.col("event_id") * F.col("event_id") % 7 * 60_000).alias("at"), F.when((F.col("event_id") / 3).cast("int") % 2 == 0, "age").otherwise("size").alias("reason"), (F.col("event_id") % 5).alias("count"), (F.col("event_id") * 10).alias("bytes_freed"), F.lit(0).cast("long").alias("age"), F.lit(1).cast("long").alias("size"))
    return R.merged_log(e).select("id", "at", "reason", "count", "bytes_freed", "rounds")


def forget_day(s, d):
    a = C.archive(s, d)
    gone = a.where(O.between(1_704_153_600_000, 1_704_153_600_000 + 86_400_000)).select("id")
    return O.without(a, gone).groupBy("domain").agg(F.count("*").alias("n"))


def pin_page(s, d):
    return O.pin(C.archive(s, d), 7).where("pinned").select("id")


QUERIES = {n: _plan(n) for n in AGES} | {f.__name__: f for f in (eviction_summary, budget, log_merge, forget_day, pin_page)}


def _plan_sql(name: str) -> str:
    months, cap = AGES[name]
    return f"""{C.SIZED}, ev AS (SELECT id, bytes, last_seen, last_seen < {R.cutoff(C.NOW, months)!r}::DOUBLE AS old FROM sized WHERE NOT pinned),
 ov AS (SELECT (SELECT sum(bytes) FROM sized) - coalesce((SELECT sum(bytes) FROM ev WHERE old), 0) - {cap} AS over_),
 rs AS (SELECT id, bytes, coalesce(sum(bytes) OVER (ORDER BY last_seen, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM ev WHERE NOT old),
 plan AS (SELECT id, bytes, 'age' AS reason FROM ev WHERE old UNION ALL SELECT id, bytes, 'size' FROM rs WHERE freed < (SELECT over_ FROM ov))"""


SQL = {n: f"WITH {_plan_sql(n)} SELECT id, bytes, reason FROM plan" for n in AGES} | {
    "eviction_summary": f"WITH {_plan_sql('eviction_both')} SELECT sum(bytes)::BIGINT AS bytes_freed, count(*) FILTER (WHERE reason = 'age') AS age, count(*) FILTER (WHERE reason = 'size') AS size, CASE WHEN count(DISTINCT reason) = 2 THEN 'both' ELSE min(reason) END AS reason FROM plan",
    "budget": f"""WITH {C.SIZED}, o AS (SELECT count(*) AS pages, count(*) FILTER (WHERE pinned) AS pinned, sum(bytes)::BIGINT AS bytes, min(first_seen) AS oldest FROM sized),
 p AS (SELECT *, bytes / {10.0 * CAP} AS fraction, ({C.NOW} - oldest) / 86400000.0 AS days FROM o)
 SELECT pages, pinned, bytes, round(fraction, 6) AS fraction, CASE WHEN fraction >= 1 THEN 'over' WHEN fraction >= 0.8 THEN 'warn' ELSE 'ok' END AS level, round(bytes / days, 3) AS bytes_per_day, floor(days + 0.5)::BIGINT AS days_observed,
 CASE WHEN fraction >= 1 THEN NULL WHEN ({10 * CAP} - bytes) / (bytes / days) > 3650 THEN NULL ELSE round({C.NOW} + ({10 * CAP} - bytes) / (bytes / days) * 86400000.0, 0) END AS exhausts_at FROM p""",
    "log_merge": """WITH e AS (SELECT event_id AS id, event_id * 400000 + event_id * event_id % 7 * 60000 AS "at", CASE WHEN event_id // 3 % 2 = 0 THEN 'age' ELSE 'size' END AS reason, event_id % 5 AS count, event_id * 10 AS bytes_freed FROM events),
 f AS (SELECT *, CASE WHEN lag(reason) OVER w = reason AND "at" - lag("at") OVER w < 600000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (ORDER BY "at", id)),
 g AS (SELECT *, sum(new) OVER (ORDER BY "at", id) AS run FROM f)
 SELECT min(id) AS id, max("at") AS "at", reason, sum(count)::BIGINT AS count, sum(bytes_freed)::BIGINT AS bytes_freed, count(*) AS rounds FROM g GROUP BY run, reason ORDER BY "at" DESC, id DESC LIMIT 500""",
    "forget_day": f"WITH {C.ARCHIVE} SELECT domain, count(*) AS n FROM arch WHERE NOT (last_seen >= 1704153600000 AND last_seen < 1704240000000) GROUP BY domain",
    "block_site": f"WITH {C.ARCHIVE} SELECT domain, count(*) AS n FROM arch WHERE domain <> 'src4.example' AND NOT ends_with(domain, '.src4.example') GROUP BY domain",
    "pin_page": f"WITH {C.ARCHIVE} SELECT id FROM arch WHERE pinned OR id = 7",
}
