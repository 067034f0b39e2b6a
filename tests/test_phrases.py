"""Phrases by the stored positions."""

from pagevault.functions.query import parse
from pagevault.operators import index as I
from pagevault.operators import search as Q

NOW = 1_706_745_600_000
TEXTS = ["the the and", "the and the and", "and the", "the x the and", "a the and the b", "the and " * 40, "x " * 50 + "the the"]


def test_phrases_without_a_row_for_each_position(spark):
    ix = I.Index.of(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").selectExpr("id", "'' AS title", "text"))
    queries = [(n, parse(t, NOW)) for n, t in enumerate(['"the the"', '"and the and"', '"the and" "and the"', '"the zzq"'])]
    found = Q.phrase_pages(ix, queries)
    padded = [" " + " ".join(t.split()) + " " for t in TEXTS]
    want = {(n, i) for n, q in queries for i, t in enumerate(padded) if all(" " + " ".join(p) + " " in t for p in q.phrases)}
    assert {tuple(r) for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # a task holds its pages' rows, not 32 for each
