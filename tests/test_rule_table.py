"""Rules as rows: the same pages as rules in an expression, in a plan that doesn't grow."""

import random

from pyspark.sql import functions as F

from pagevault.functions import rules as R
from pagevault.operators import rule_table as T


def rules_and_urls(seed, n):
    r = random.Random(seed)
    label = lambda: r.choice(["a", "b", "mail", "www", "x", "intra"])
    host = lambda: r.choice([".".join(label() for _ in range(r.randint(1, 3))) + r.choice([".example", ".org", ""]), "10.0.0.1", "localhost", "EXAMPLE.org."])
    path = lambda: r.choice(["", "/", "/en", "/en/", "/en/x", "/de/Y?z=1#f"])
    rules = [r.choice([host() + path(), host() + "/en/*", "*." + host(), label() + ".*", "@private-network", "", "https://u@" + host() + ":80" + path()]) for _ in range(n)]
    urls = [r.choice(["https://", "http://www.", "ftp://"]) + host() + path() for _ in range(150)] + ["", "no address", None]
    return rules, urls


def test_same_as_in_an_expression(spark):
    for seed in (1, 2):
        rules, urls = rules_and_urls(seed, 12)
        pages = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
        want = {r.id for r in pages.where(R.any_match(F.col("url"), rules)).collect()}
        found = T.excluded(pages, T.of(spark, rules)).collect()
        assert {r.id for r in found} == want and want
        each = {(r.id, r.rule) for r in T.covered(pages, T.of(spark, rules)).collect()}
        assert {x for x in each} == {(r.id, rule) for rule in set(rules) for r in pages.where(R.any_match(F.col("url"), [rule])).collect()}
    assert T.excluded(pages.limit(0), T.of(spark, rules)).count() == 0 and T.excluded(pages, T.of(spark, [])).count() == 0


def test_ten_thousand_rules(spark):
    rules = [f"site{i}.example/p{i % 7}/*" for i in range(10_000)]
    pages = spark.range(3000).selectExpr("id", "concat('https://www.site', id * 5, '.example/p', id % 7, '/x') url")
    size = lambda n: len(T.excluded(pages, T.of(spark, rules[:n]))._jdf.queryExecution().optimizedPlan().toString())
    assert size(10_000) < size(10) * 1.2
    want = {i for i in range(2000) if 5 * i % 7 == i % 7}
    assert {r.id for r in T.excluded(pages, T.of(spark, rules)).collect()} == want
