"""Addresses that open at a phrase: the query on odd texts, and the function beside it."""

import duckdb
from pyspark.sql import functions as F

from pagevault.functions import urls as U
from pagevault.plans import retrieval

TEXTS = ["", "   ", None, " no break　", "   ", "\tkept\n", "ends \n", "a-b ~*!\'() %21 + é", "x" * 39 + " y", "​joined", "old #part"]


def test_query_on_odd_texts(spark, tmp_path):
    docs = [(i, t, None if i == 5 else "src#1" if i == 6 else "src") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(len(docs)).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in retrieval.text_fragments(spark, str(tmp_path)).collect()}
    assert got == set(con.sql(retrieval.SQL["text_fragments"]).fetchall())
    assert {(0, "https://src.example/0#:~:text="), (2, None), (3, "https://src.example/3#:~:text=no%20break")} <= got


def test_function(spark):
    cases = [("https://a.example/x#old", "one-two"), ("https://a.example/x#old", ""), ("https://a.example/x", None)]
    got = spark.createDataFrame(cases, "u string, p string").select(U.text_fragment(F.col("u"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["https://a.example/x#:~:text=one%2Dtwo", "https://a.example/x#old", "https://a.example/x"]
