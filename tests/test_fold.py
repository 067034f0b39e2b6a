"""Folding incoming pages: one key with a third of all rows, against a fold row by row."""

import random

import pytest
from pyspark.sql import functions as F

from pagevault.operators import store as O
from pagevault.schemas import ARCHIVE, PAGE_INPUT

SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAGE_INPUT) + ", arrival long"


def rows_of(seed, n):
    r = random.Random(seed)
    for i in r.sample(range(10 * n), n):
        url = "https://hot.example/" if r.random() < 0.34 else f"https://s.example/{r.randrange(40)}"
        yield (url, "t", r.choice(["one", "two", "two", "three"]), r.randrange(1000), r.random() < 0.3, r.choice([None, None, 5, 70]), r.choice([None, None, None, 4]), i)


def fold(held, rows):
    """Row by row, as the archive would be changed by one page after the other."""
    held = {k: dict(v) for k, v in held.items()}
    for url, title, text, seen, pinned, first, visits, _ in sorted(rows, key=lambda x: x[-1]):
        p = held.get(url)
        if p is None:
            held[url] = dict(id=max((x["id"] for x in held.values()), default=0) + 1, text=text, first=seen if first is None else first, seen=seen, visits=1 if visits is None else visits, pinned=pinned)
        elif p["text"] == text:
            p["visits"] += 1
            p["seen"] = max(p["seen"], seen)
        else:
            p.update(text=text, seen=max(p["seen"], seen), first=p["first"] if first is None else first, visits=p["visits"] + 1 if visits is None else visits)
    return held


def as_held(df):
    return {r.url: dict(id=r.id, text=r.text, first=r.first_seen, seen=r.last_seen, visits=r.visit_count, pinned=r.pinned) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_hot_key(spark, seed):
    first, second = list(rows_of(seed, 60)), list(rows_of(seed + 10, 300))
    one = O.upsert(spark.createDataFrame([], ARCHIVE), spark.createDataFrame(first, SCHEMA))
    one = spark.createDataFrame(one.collect(), one.schema)
    assert as_held(one) == (want := fold({}, first))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        two = O.upsert(one, spark.createDataFrame(second, SCHEMA))
        assert as_held(two) == fold(want, second)
        # the hot key lies in several stretches
        rows = O.keyed(spark.createDataFrame(second, SCHEMA)).select("url_key", "arrival").repartitionByRange("url_key", "arrival").withColumn("s", F.spark_partition_id())
        assert rows.where("url_key = 'https://hot.example/'").select("s").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
