"""The storage budget: what to evict, the deletion log, and projections.

Decisions are set-based: the age rule and the size rule are window sums over the
whole archive, and apply to unpinned pages only, oldest first (ties by id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault import schemas as S


def cutoff(now: int, months: float | None = S.RETENTION_MONTHS) -> float:
    return now - (months if months and months > 0 else S.RETENTION_MONTHS) * S.MONTH_MS


def plan(archive: DataFrame, now: int, months: float | None = S.RETENTION_MONTHS, cap: int | None = S.SIZE_CAP, apply_age: bool = True) -> DataFrame:
    """Pages to evict: id, bytes, reason (age, size).

    Pages are summed by hour first.  Hours that the size rule frees whole are taken
    without ordering their pages; only in the one hour that it cuts is there a
    running sum, minute by minute and then page by page in the one minute that is
    cut - no window runs over more than the pages of a minute.
    """
    old = F.col("last_seen") < F.lit(cutoff(now, months)) if apply_age else F.lit(False)
    pages = archive.select("id", "last_seen", F.coalesce("bytes", F.lit(0)).alias("bytes"), "pinned")
    loose = pages.where(~F.coalesce("pinned", F.lit(False)))
    aged = loose.where(old).select("id", "bytes", F.lit("age").alias("reason"))
    if not cap or cap <= 0:
        return aged
    rest = loose.where(~F.coalesce(old, F.lit(False)))
    # bytes still over the cap once the age rule is done
    over = (pages.agg(F.coalesce(F.sum("bytes"), F.lit(0))).scalar() - aged.agg(F.coalesce(F.sum("bytes"), F.lit(0))).scalar() - F.lit(cap)).alias("over")
    whole, cut = _oldest(rest, F.floor(F.col("last_seen") / S.HOUR_MS), over)
    minutes, part = _oldest(cut, F.floor(F.col("last_seen") / S.MINUTE_MS), over)
    w = Window.orderBy(F.asc_nulls_first("last_seen"), "id").rowsBetween(Window.unboundedPreceding, -1)
    pages = part.withColumn("freed", F.col("before") + F.coalesce(F.sum("bytes").over(w), F.lit(0))).where(F.col("freed") < over)
    sized = whole.select("id", "bytes").unionByName(minutes.select("id", "bytes")).unionByName(pages.select("id", "bytes"))
    return aged.unionByName(sized.select("id", "bytes", F.lit("size").alias("reason")))


def _oldest(pages: DataFrame, span: Column, over: Column) -> tuple[DataFrame, DataFrame]:
    """Pages of the spans of time that are needed whole to free ``over`` bytes, oldest first, and those of the one span that is cut.

    Pages may carry ``before``, the bytes freed before all of them.
    """
    start = F.max("before") if "before" in pages.columns else F.lit(0)
    spans = pages.groupBy(span.alias("_span")).agg(F.sum("bytes").alias("_b"), start.alias("_start"))
    w = Window.orderBy(F.asc_nulls_first("_span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_b").over(w), F.lit(0)) + F.col("_start")).where(F.col("_before") < over)
    # ``whole``: everything in it goes, as what is freed before its last page is still too little
    spans = spans.select("_span", F.col("_before"), (F.col("_before") + F.col("_b") < over).alias("_whole"))
    met = pages.drop("before").withColumn("_of", span).join(spans, F.col("_of").eqNullSafe(F.col("_span")))
    kept = lambda x: x.drop("_of", "_span", "_whole").withColumnRenamed("_before", "before")
    return kept(met.where("_whole")), kept(met.where("NOT _whole"))


def summary(evicted: DataFrame) -> DataFrame:
    """One row: bytes freed, counts by rule and the reason as logged."""
    age, size = F.count_if(F.col("reason") == "age"), F.count_if(F.col("reason") == "size")
    label = F.when((age > 0) & (size > 0), "both").when(age > 0, "age").when(size > 0, "size")
    return evicted.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_freed"), age.alias("age"), size.alias("size"), label.alias("reason"))


def budget(used: Column, cap: int, warn: float = S.WARN_AT) -> Column:
    share = used / F.lit(float(cap)) if cap > 0 else F.lit(0.0)
    return F.struct(share.alias("fraction"), F.when(share >= 1, "over").when(share >= warn, "warn").otherwise("ok").alias("level"))


def pace(total: Column, oldest: Column, now: int) -> Column:
    """Bytes a day and days observed; zeros under a day, for an empty archive and for dates ahead of the clock."""
    days = (F.lit(now) - oldest) / S.DAY_MS
    known = (F.coalesce(total, F.lit(0)) > 0) & (F.coalesce(oldest, F.lit(0)) > 0) & (days >= 1)
    return F.struct(F.when(known, total / days).otherwise(0.0).alias("bytes_per_day"), F.when(known, F.floor(days + 0.5)).otherwise(0).alias("days_observed"))


def exhausted_at(used: Column, cap: int, per_day: Column, now: int) -> Column:
    days = (F.lit(cap) - used) / F.nullif(per_day, F.lit(0.0))
    return F.when(F.coalesce(per_day, F.lit(0.0)) <= 0, None).when(used >= cap, F.lit(float(now))).when(days > 3650, None).otherwise(now + days * S.DAY_MS)


def clock_problem(now: int, last_sweep: int | None) -> str | None:
    """Why the time since the last sweep can't be right, if it lies outside what an hourly sweep can see."""
    passed = now - last_sweep if last_sweep else 0
    outside = (passed > S.CLOCK_JUMP_MS) - (passed < -S.CLOCK_BACK_MS)
    return (None, "more time has passed than an hourly sweep can account for", "the clock has moved backwards since the last sweep")[outside]


def clock_hold(now: int, last_sweep: int | None = None, hold_until: int | None = None, last_problem: str | None = None) -> tuple[str | None, int]:
    """(problem, held until): the age rule rests for a day after a jump; longer holds aren't believed."""
    new = clock_problem(now, last_sweep)
    left = S.CLOCK_HOLD_MS if new else (hold_until or 0) - now
    resting = 0 < left <= S.CLOCK_HOLD_MS
    return (new or last_problem or "the clock jumped recently", now + left) if resting else (None, 0)


def merged_log(rounds: DataFrame, keep: int = S.LOG_ROWS) -> DataFrame:
    """Rounds (id, at, reason, count, bytes_freed, age, size) folded: one row while the reason stays and gaps stay under ten minutes.

    Runs are found within each day; only a day's first and last round meet the
    days beside it, so no window runs over the whole log.  The log is trimmed to
    the newest 500.
    """
    rounds = rounds.withColumn("_day", F.floor(F.col("at") / S.DAY_MS))
    w = Window.partitionBy("_day").orderBy("at", "id")
    goes_on = lambda reason, at: F.coalesce(reason.eqNullSafe(F.col("reason")) & (F.col("at") - at < S.LOG_GAP_MS), F.lit(False))
    new = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(goes_on(F.lag("reason").over(w), F.lag("at").over(w)), 0).otherwise(1))
    runs = rounds.withColumn("_new", new).withColumn("_within", F.sum("_new").over(w))
    edge = F.struct("at", "id", "reason")
    days = runs.groupBy(F.col("_day").alias("_of")).agg(F.sum("_new").alias("_n"), F.min(edge).alias("_first"), F.max(edge).alias("_last"))
    over = Window.orderBy(F.asc_nulls_first("_of"))
    last = F.lag("_last").over(over)
    joins = F.coalesce(last["reason"].eqNullSafe(F.col("_first.reason")) & (F.col("_first.at") - last["at"] < S.LOG_GAP_MS), F.lit(False))
    days = days.withColumn("_starts", F.when(joins, 0).otherwise(1))
    before = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_of", (before + F.sum("_starts").over(over.rowsBetween(Window.unboundedPreceding, 0))).alias("_before"))
    runs = runs.join(days, F.col("_day").eqNullSafe(F.col("_of"))).withColumn("_run", F.col("_before") + F.col("_within"))
    total = lambda c: F.sum(c).cast("long").alias(c)
    folded = runs.groupBy("_run", "reason").agg(F.min("id").alias("id"), F.max("at").alias("at"), total("count"), total("bytes_freed"), total("age"), total("size"), F.count(F.lit(1)).alias("rounds")).drop("_run")
    return folded.orderBy(F.desc("at"), F.desc("id")).limit(keep)


def read_log(log: DataFrame, limit: int = S.LOG_READ) -> DataFrame:
    """The newest rows of the deletion log; the later number first where times are equal."""
    return log.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def overview(archive: DataFrame, now: int, cap: int = S.SIZE_CAP) -> DataFrame:
    """One row of statistics: pages, pinned pages, bytes, budget, pace and when the budget is used up."""
    a = archive.agg(F.count(F.lit(1)).alias("pages"), F.count_if("pinned").alias("pinned"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("first_seen").alias("oldest"))
    p, b = pace(F.col("bytes"), F.col("oldest"), now), budget(F.col("bytes"), cap)
    a = a.select("*", b["fraction"].alias("fraction"), b["level"].alias("level"), p["bytes_per_day"].alias("bytes_per_day"), p["days_observed"].alias("days_observed"))
    return a.withColumn("exhausts_at", F.when((F.col("days_observed") >= 7) & (F.col("level") != "over"), exhausted_at(F.col("bytes"), cap, F.col("bytes_per_day"), now)))
