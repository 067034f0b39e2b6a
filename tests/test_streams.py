"""Streams with state: timers that drop it, restarts, late ticks, and pages that two sources file."""

import pytest
from pyspark.sql import functions as F

from pagevault.streaming import ingest as T
from pagevault.streaming import reading as G

TICKS = "user_id long, page string, ms long"


class Source:
    """A folder that files are put into, one a micro-batch, and a query over it that can be stopped and started again."""

    def __init__(self, spark, path, schema, build, name):
        self.spark, self.path, self.schema, self.build, self.name, self.n = spark, path, schema, build, name, 0

    def put(self, rows):
        df = self.spark.createDataFrame(rows, self.schema).withColumn("ts", F.timestamp_millis(F.col("ms") + 1_000_000)).drop("ms").coalesce(1)
        df.write.mode("append").parquet(f"file://{self.path}/in")
        self.kind = df.schema

    def run(self):
        """One run over what was put since the last, from the checkpoint."""
        self.n += 1
        stream = self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", 1).parquet(f"file://{self.path}/in")
        out = f"{self.path}/out"
        q = self.build(stream).writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{self.path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        last = [p for p in q.recentProgress if p["stateOperators"]]
        self.held = last[-1]["stateOperators"][0]["numRowsTotal"] if last else None
        return sorted(tuple(r) for r in self.spark.read.parquet(f"file://{out}").collect())


def test_state_of_idle_readers_is_dropped(spark, tmp_path):
    s = Source(spark, tmp_path, TICKS, lambda df: T.dwell_stream(df, late="10 seconds", idle_ms=60_000), "dwell")
    s.put([(k, "p", ms) for k in range(20) for ms in (0, 2500)])
    assert s.run() == [] and s.held == 20
    s.put([(3, "p", 5000), (3, "p", 4000)])  # a restart goes on where it was; the tick out of order adds nothing
    assert s.run() == [(3, "p", 5000)]
    s.put([(99, "p", 500_000)])
    s.put([(99, "p", 500_500)])  # the watermark has passed all other timers
    s.run()
    assert s.held == 1
    s.put([(4, "p", 501_000), (4, "p", 503_500), (5, "p", 100)])  # 4 starts anew; 5 comes behind the watermark
    s.put([(4, "p", 506_000)])
    assert s.run() == [(3, "p", 5000), (4, "p", 5000)]
    assert s.held == 2


@pytest.mark.parametrize("visible", [True, False])
def test_reading_states(visible):
    class Tick:
        def __init__(self, ms, url="u", scroll=0.0, words=900, refusal=None):
            self.ts, self.url, self.visible, self.scroll, self.words, self.pdf, self.refusal = self, url, visible, scroll, words, False, refusal
            self.timestamp = lambda: ms / 1000

    r = G.Reading("u", 0)
    for k in range(1, 4):
        r = r.after(Tick(2500 * k, "u#x"))
    assert r.focused == (7500 if visible else 0) and r.due is visible
    if visible:
        r, said = r.offered(Tick(7500))
        assert said == "still reading" and not r.due and r.wait == 10_000
        assert r.after(Tick(7600, scroll=0.06)).due and r.after(Tick(7600, "v")) == G.Reading("v", 7600)
        closed, said = r.after(Tick(10_000)).offered(Tick(10_000, refusal="no"))
        assert said == "no" and closed.closed and not closed.after(Tick(99_000)).due


PAGES = "url string, title string, text string, ms long"


def test_two_sources_store_one_page(spark, tmp_path):
    s = Source(spark, tmp_path, PAGES, lambda df: T.once(df, "1 minute").select("url_key", "text"), "once")
    s.put([("https://a.example/#x", "t", "one", 1000), ("https://a.example/", "t", "one", 1500), ("ftp://no", "t", "x", 1)])
    s.put([("https://a.example/?utm_source=f", "t", "one", 2000), ("https://a.example/", "t", "two", 2500)])
    assert s.run() == [("https://a.example/", "one"), ("https://a.example/", "two")]
    s.put([("https://b.example/", "t", "b", 900_000)])
    s.put([("https://b.example/", "t", "b", 900_001), ("https://c.example/", "t", "c", 900_002)])
    assert len(s.run()) == 4 and s.held <= 2  # what lies behind the watermark is forgotten
