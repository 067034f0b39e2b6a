"""Search: a few plans for a whole batch of queries.

Query words are a small table (it holds what people typed; broadcast if it is
counted as small).  Word resolution touches the words of the dictionary that share
the first letters with what was typed (``nearby``: a filter that reaches the scan).
Postings are read by the names of the resolved terms (``index.lists``), so a search
reads their buckets, not the corpus.  AND starts from the rarest word of each query:
its pages are found first, and of the longer lists only what stands on those pages
is aggregated.  Only queries without such a page fall back to OR and read all their
lists.  Hits are settled once and feed weights, phrases, totals and the ranking.
All filters stand below the cut to the first 500; ranking inside the cut is exact.

``whole`` lifts the caps: a word stands for all terms that it can be resolved to, phrases
are looked for beyond the stored positions, in the texts of the pages that have
more, and every page is scored exactly.

``top`` finds the same first pages without the total: blocks of ids whose greatest
frequencies cannot reach the score of the last page wanted are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault import schemas as S
from pagevault.functions import text as X
from pagevault.functions.passages import snippet_udf
from pagevault.functions.query import Query
from pagevault.operators.index import BLOCK_BITS, Index, lists, named, statistics
from pagevault.operators.scratch import given, settle, small
from pagevault.operators.store import marked

EXACT, SINGULAR, STEM, PREFIX, TYPO = range(5)
BEGINNINGS = 500  # first letters that a filter names at most
ROUNDING = 1e-9  # by which a block's bound may fall short of a page's score


def words_table(spark: SparkSession, queries: Sequence[tuple[int, Query]]) -> DataFrame:
    rows = [(q, t, i, any(t in p for p in parsed.phrases)) for q, parsed in queries for i, t in enumerate(parsed.lookup)]
    return given(spark, rows, "query int, word string, place int, fixed boolean")


def nearby(dictionary: DataFrame, queries: Sequence[tuple[int, Query]], languages: Sequence[str] = (), stem: Callable | None = None) -> DataFrame:
    """The settled part of the dictionary that the queries' words can be resolved to: whole words, and words with the same first letters."""
    typed = sorted({t for _, q in queries for t in q.lookup})
    first = {t[: S.PREFIX_CHARS] for t in typed if len(t) >= S.PREFIX_CHARS}
    if languages and stem and typed:
        words = dictionary.sparkSession.createDataFrame([(t,) for t in typed], "word string")
        stems = words.select(F.explode(F.array(*(stem(F.col("word"), F.lit(x)) for x in languages))).alias("stem")).where(F.length("stem") >= S.PREFIX_CHARS)
        first |= {r[0] for r in stems.select(F.left("stem", F.lit(S.PREFIX_CHARS))).distinct().collect()}
    short = [t for t in typed if len(t) < S.PREFIX_CHARS]
    if len(first) <= BEGINNINGS:
        found = dictionary.where(reduce(or_, [*(F.col("term").startswith(x) for x in sorted(first)), F.col("term").isin(short)]))
    else:  # too many for a filter
        begun = given(dictionary.sparkSession, [(x,) for x in sorted(first)], "_k string")
        found = dictionary.join(begun, F.left("term", F.lit(S.PREFIX_CHARS)) == F.col("_k"), "left_semi")
        found = found.unionByName(dictionary.where(F.col("term").isin(short)))
    return settle(found, "nearby")


def prefix_terms(dictionary: DataFrame, wanted: DataFrame, scan: int | None = None, limit: int | None = None, fits: Column | None = None) -> DataFrame:
    """For rows with ``prefix``: of the first ``scan`` terms alphabetically those that fit, then the ``limit`` most frequent; ``ord`` from 1.

    An equi-join on the first three characters carries the prefix test.
    """
    keyed = wanted.withColumn("_k", F.left("prefix", F.lit(S.PREFIX_CHARS)))
    hit = dictionary.withColumn("_k", F.left("term", F.lit(S.PREFIX_CHARS))).join(keyed, "_k").where(F.col("term").startswith(F.col("prefix"))).drop("_k")
    by = Window.partitionBy(*wanted.columns)
    if scan is not None:
        hit = hit.withColumn("_n", F.row_number().over(by.orderBy("term"))).where(F.col("_n") <= scan).drop("_n")
    fit = hit if fits is None else hit.where(fits)
    ranked = fit.withColumn("ord", F.row_number().over(by.orderBy(F.desc("df"), "term")))
    return ranked if limit is None else ranked.where(F.col("ord") <= limit)


def resolve(dictionary: DataFrame, words: DataFrame, languages: Sequence[str] = (), stem: Callable | None = None, whole: bool = False) -> DataFrame:
    """(query, word, term, df, level, ord): each word's terms at its first level that has any.

    Exact, singular, stem, prefix, typo, in this order; words of a phrase are
    exact or nothing.  ``whole``: all of a level's terms, however many.
    """
    scan, limit, checked = (None, None, None) if whole else (S.PREFIX_SCAN, S.PREFIX_LIMIT, S.TYPO_SCAN)
    w = words.select("query", "word", "fixed")
    free = w.where(~F.col("fixed")).drop("fixed")
    level = lambda df, n: df.select("query", "word", "term", "df", F.lit(n).alias("level"), "ord")
    exact = level(dictionary.join(w, F.col("term") == F.col("word")).withColumn("ord", F.lit(1)), EXACT)
    try_ = free.select("query", "word", F.posexplode(X.variants(F.col("word"))).alias("_v", "_variant"))
    single = dictionary.join(try_, F.col("term") == F.col("_variant"))
    first = single.groupBy("query", "word").agg(F.min_by(F.struct("term", "df"), "_v").alias("t")).select("query", "word", "t.term", "t.df", F.lit(1).alias("ord"))
    start = free.where(F.length("word") >= S.PREFIX_CHARS).withColumn("prefix", F.col("word"))
    longer = prefix_terms(dictionary, start, scan, limit)
    near = free.where(F.length("word") >= S.TYPO_CHARS).withColumn("prefix", F.left("word", F.lit(S.TYPO_PREFIX)))
    budget = F.when(F.length("word") >= S.TYPO_LONG, 2).otherwise(1)
    typo = prefix_terms(dictionary, near, checked, limit, F.levenshtein("word", "term") <= budget)
    every = exact.unionByName(level(first, SINGULAR)).unionByName(level(longer, PREFIX)).unionByName(level(typo, TYPO))
    if languages and stem:
        for i, lang in enumerate(languages):
            stemmed = free.withColumn("prefix", stem(F.col("word"), F.lit(lang))).where(F.length("prefix") >= S.PREFIX_CHARS)
            family = prefix_terms(dictionary, stemmed, checked, checked).where(stem(F.col("term"), F.lit(lang)) == F.col("prefix"))
            every = every.unionByName(family.select("query", "word", "term", "df", (F.lit(STEM) + F.lit(i / 100)).alias("level"), "ord"))
    low = F.min("level").over(Window.partitionBy("query", "word"))
    return every.withColumn("_low", low).where(F.col("level") == F.col("_low")).select("query", "word", "term", "df", F.floor("level").cast("int").alias("level"), "ord")


def _by_terms(ix: Index, terms: Sequence[str]) -> DataFrame:
    """Postings of terms that the driver holds, read by their buckets."""
    return lists(ix.postings, named(ix.postings.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")))


def _holding(ix: Index, queries: Sequence[tuple[int, Query]], asked_of: DataFrame) -> DataFrame:
    """Those of the settled (query, phrase, id) whose page holds the phrase, by its text.  Only texts of these pages are taken apart, where they lie."""
    said = [(q, k, " " + " ".join(p) + " ") for q, parsed in queries for k, p in enumerate(parsed.phrases)]
    pages = marked(ix.archive.select("id", "title", "text"), asked_of.select("id")).where("_marked")
    words = X.terms(X.indexed_text(F.col("title"), F.col("text")))  # a dropped word keeps its place, as what is no word
    texts = pages.select("id", F.concat(F.lit(" "), F.array_join(words, " ", "-"), F.lit(" ")).alias("words"))
    held = texts.crossJoin(given(ix.archive.sparkSession, said, "query int, phrase int, said string")).where(F.contains("words", "said"))
    return held.select("query", "phrase", "id").join(small(asked_of), ["query", "phrase", "id"])


def phrase_pages(ix: Index, queries: Sequence[tuple[int, Query]], within: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(query, id) of pages (of ``within``, if given) that hold every phrase of a query, by the stored positions.

    ``whole``: pages that have a word of a phrase more often than positions are stored, and not the
    phrase among these, are looked up in their texts.
    """
    rows = [(q, k, i, t, len(p), len(parsed.phrases)) for q, parsed in queries for k, p in enumerate(parsed.phrases) for i, t in enumerate(p)]
    want = given(ix.postings.sparkSession, rows, "query int, phrase int, step int, term string, steps int, phrases int")
    held = _by_terms(ix, [r[3] for r in rows]).join(want, "term")
    held = held if within is None else held.join(within, ["query", "id"], "left_semi")
    starts = F.transform("pos", lambda p: p - F.col("step"))  # 32 at most, so a phrase's rows on a page are one small row
    each = held.groupBy("query", "phrase", "id", "steps", "phrases").agg(F.collect_list(starts).alias("starts"), F.max(F.size("pos") < F.col("tf")).alias("more")).where(F.size("starts") == F.col("steps"))
    met = F.size(F.aggregate("starts", F.col("starts")[0], F.array_intersect)) > 0
    if whole:
        each = settle(each.select("query", "phrase", "id", "phrases", met.alias("met"), "more").where("met OR more"), "phrases")
        rest = settle(each.where("NOT met").select("query", "phrase", "id", "phrases"), "rest")
        found = each.where("met").select(rest.columns).unionByName(_holding(ix, queries, rest))
    else:
        found = each.where(met)
    return found.groupBy("query", "id", "phrases").agg(F.count(F.lit(1)).alias("n")).where("n = phrases").select("query", "id")


def _hits(ix: Index, wanted: DataFrame, within: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(query, word, id, level, tf) of the settled wanted terms, on the pages of ``within`` or in the settled ``blocks`` if given."""
    of = None if blocks is None else [r.block for r in blocks.select("block").distinct().collect()]  # a block stands for 2 ** BLOCK_BITS pages
    held = lists(ix.postings, named(wanted), of).select("term", "id", "tf").join(small(wanted), "term")
    if within is not None:
        held = held.join(small(within), ["query", "id"], "left_semi")
    if blocks is not None:
        held = held.withColumn("block", F.shiftright("id", BLOCK_BITS)).join(small(blocks.select("query", "block")), ["query", "block"], "left_semi")
    return held.groupBy("query", "word", "id", "level").agg(F.sum("tf").alias("tf"))


@dataclass
class Asked:
    """What a batch of queries asks for: its settled terms (query, word, term, df, level, ``rarest``, ``whole``: all words of the query are known) and weights (query, word, idf)."""

    queries: list[tuple[int, Query]]
    wanted: DataFrame
    weights: DataFrame
    sizes: DataFrame  # (query, k): words of each query


def asked(ix: Index, queries: Sequence[tuple[int, Query]], languages: Sequence[str] = (), stem: Callable | None = None, whole: bool = False) -> Asked:
    spark = ix.postings.sparkSession
    queries = [(q, p) for q, p in queries if not p.empty]
    k = given(spark, [(q, len(p.lookup)) for q, p in queries], "query int, k int")
    near = nearby(ix.dictionary, queries, languages, stem)
    words = settle(resolve(near, words_table(spark, queries), languages, stem, whole), "resolved").select("query", "word", "term", "df", "level")
    each = words.groupBy("query", "word").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("most"))
    by = Window.partitionBy("query")
    each = each.withColumn("_rank", F.row_number().over(by.orderBy("most", "word"))).withColumn("_words", F.count(F.lit(1)).over(by)).join(k, "query")
    each = each.select("query", "word", "terms", "most", (F.col("_words") == F.col("k")).alias("whole"), (F.col("_rank") == 1).alias("rarest"))
    wanted = settle(words.join(each, ["query", "word"]), "wanted")
    df = wanted.where("terms = 1").select("query", "word", F.col("most").alias("df"))
    wide = settle(wanted.where("terms > 1").select("query", "word", "term"), "wide")
    if not wide.isEmpty():
        pages = lists(ix.postings, named(wide)).select("term", "id").join(small(wide), "term").select("query", "word", "id").distinct()
        df = df.unionByName(pages.groupBy("query", "word").agg(F.count(F.lit(1)).alias("df")))
    n = ix.archive.agg(F.count(F.lit(1))).scalar()
    return Asked(queries, wanted, settle(df.select("query", "word", X.idf(F.col("df"), n).alias("idf")), "weights"), k)


def matched(ix: Index, of: Asked) -> tuple[DataFrame, list[int]]:
    """Settled hits (query, word, id, level, tf) of the pages that AND, or else OR, finds; and the queries that AND serves."""
    spark, wanted = ix.postings.sparkSession, of.wanted
    terms = lambda condition: settle(wanted.where(condition).select("query", "word", "term", "level"), "terms")
    rare = settle(_hits(ix, terms("whole AND rarest")), "rarest")
    others = terms("whole AND NOT rarest")
    alone = others.isEmpty()
    both = rare if alone else settle(rare.unionByName(_hits(ix, others, settle(rare.select("query", "id").distinct(), "pages"))), "both")
    full = both.groupBy("query", "id").agg(F.count(F.lit(1)).alias("m")).join(of.sizes, "query").where("m = k").select("query", "id")
    full = settle(full, "full")
    served = sorted(r.query for r in full.select("query").distinct().collect())  # as many as were asked at most
    hits = both if alone else both.join(full, ["query", "id"], "left_semi")
    rest_of = [(q,) for q, _ in of.queries if q not in set(served)]
    if rest_of:
        some = wanted.join(given(spark, rest_of, "query int"), "query").select("query", "word", "term", "level")
        hits = hits.unionByName(_hits(ix, settle(some, "fallback")))
    return settle(hits, "hits"), served


def _filtered(ix: Index, of: Asked, hits: DataFrame, served: Sequence[int], site: str | None = None, after: int | None = None, before: int | None = None, whole: bool = False) -> DataFrame:
    """(query, id, mode, parts, prescore) of settled hits, all filters applied; a settled table."""
    spark, queries = ix.postings.sparkSession, of.queries
    part = F.struct("word", "tf", "idf", (F.col("level") >= STEM).alias("wide"))
    pages = hits.join(small(of.weights), ["query", "word"]).groupBy("query", "id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    # summed in word order, so that equal pages get equal scores
    pages = pages.withColumn("prescore", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["idf"] * (1 + F.log(p["tf"]))))
    modes = given(spark, [(q, "and" if q in set(served) else "or") for q, _ in queries], "query int, mode string")
    pages = pages.join(modes, "query")
    out = [(q, t) for q, p in queries for t in p.exclude]
    if out:
        gone = _by_terms(ix, [t for _, t in out]).join(given(spark, out, "query int, term string"), "term").select("query", "id").distinct()
        pages = pages.join(gone, ["query", "id"], "left_anti")
    if any(p.phrases for _, p in queries):
        held = phrase_pages(ix, queries, hits.select("query", "id").distinct(), whole).withColumn("_held", F.lit(True))
        strict = given(spark, [(q, bool(p.phrases)) for q, p in queries], "query int, strict boolean")
        pages = pages.join(strict, "query").join(held, ["query", "id"], "left").where("NOT strict OR _held").drop("strict", "_held")
    late = lambda a, b: max(a, b) if a and b else a or b or None
    soon = lambda a, b: min(a, b) if a and b else a or b or None
    bounds = [(q, (p.site or site or "").lower().removeprefix("www.") or None, late(p.after, after), soon(p.before, before)) for q, p in queries]
    if any(x for b in bounds for x in b[1:]):
        b = given(spark, bounds, "query int, site string, low long, high long")
        seen = F.col("last_seen")
        ok = (F.col("site").isNull() | (F.col("domain") == F.col("site")) | F.col("domain").endswith(F.concat(F.lit("."), "site")))
        ok &= (F.col("low").isNull() | (seen >= F.col("low"))) & (F.col("high").isNull() | (seen < F.col("high") + 1))
        pages = pages.join(b, "query").join(ix.archive.select("id", "domain", "last_seen"), "id").where(F.coalesce(ok, F.lit(False))).drop("site", "low", "high", "domain", "last_seen")
    return settle(pages.select("query", "id", "mode", "parts", "prescore"), "found")


def candidates(ix: Index, queries: Sequence[tuple[int, Query]], languages: Sequence[str] = (), stem: Callable | None = None, whole: bool = False, **filters) -> DataFrame:
    """(query, id, mode, parts, prescore): every page in the answer, all filters (site, after, before) applied; a settled table."""
    of = asked(ix, queries, languages, stem, whole)
    hits, served = matched(ix, of)
    return _filtered(ix, of, hits, served, whole=whole, **filters)


def bounds(ix: Index, of: Asked, queries: DataFrame, every: bool) -> DataFrame:
    """(query, block, bound, pages) of the blocks that can hold a page of a query: the most its score can be, and a guess of its pages there.

    A word's frequency is at most the sum of its terms' greatest ones.
    """
    wanted = settle(of.wanted.join(queries, "query").select("query", "word", "term"), "terms")
    held = lists(ix.impacts, named(wanted)).select("term", "block", "most", "pages").join(small(wanted), "term")
    words = held.groupBy("query", "word", "block").agg(F.sum("most").alias("most"), F.max("pages").alias("pages")).join(small(of.weights), ["query", "word"])
    blocks = words.groupBy("query", "block").agg(F.sum(F.col("idf") * (1 + F.log("most"))).alias("bound"), (F.min("pages") if every else F.max("pages")).alias("pages"), F.count(F.lit(1)).alias("m"))
    return blocks.join(of.sizes, "query").where("m = k" if every else "m > 0").select("query", "block", (F.col("bound") + ROUNDING).alias("bound"), "pages")


def _by_blocks(ix: Index, of: Asked, queries: DataFrame, every: bool, most: int, **filters) -> tuple[DataFrame, list[int], DataFrame]:
    """The first ``most`` pages and more of some queries; the queries with a page before filters; and (query, blocks, read)."""
    wanted = settle(of.wanted.join(queries, "query").select("query", "word", "term", "level"), "terms")
    blocks = settle(bounds(ix, of, queries, every), "bounds")
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    ahead = F.sum("pages").over(best.rowsBetween(Window.unboundedPreceding, -1))
    first = settle(blocks.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("_ahead") < 2 * most).drop("_ahead"), "first-blocks")

    def pages(some: DataFrame) -> tuple[DataFrame, set[int]]:
        hits = _hits(ix, wanted, blocks=some)
        if every:
            full = Window.partitionBy("query", "id")
            hits = hits.withColumn("_m", F.count(F.lit(1)).over(full)).join(of.sizes, "query").where("_m = k").drop("_m", "k")
        hits = settle(hits, "hits")
        served = {r.query for r in hits.select("query").distinct().collect()}
        return _filtered(ix, of, hits, served if every else (), **filters), served

    found, served = pages(first)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("prescore"), "id"))
    least = found.withColumn("_r", rank).where(F.col("_r") == most).select("query", F.col("prescore").alias("least"))
    rest = blocks.join(first, ["query", "block"], "left_anti").join(settle(least, "least"), "query", "left")
    rest = settle(rest.where("least IS NULL OR bound >= least").select("query", "block"), "rest-blocks")
    if not rest.isEmpty():
        more, also = pages(rest)
        found, served = settle(found.unionByName(more), "found"), served | also
    read = first.select("query", "block").unionByName(rest).groupBy("query").agg(F.count(F.lit(1)).alias("read"))
    return found, sorted(served), blocks.groupBy("query").agg(F.count(F.lit(1)).alias("blocks")).join(read, "query")


def top(ix: Index, queries: Sequence[tuple[int, Query]], most: int = S.HEAD, languages: Sequence[str] = (), stem: Callable | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` pages of each query by prescore, as in ``candidates`` (a few more come along), and per query: blocks that can hold its pages, and those read.

    Some of the best blocks are scored first.  If the ``most``-th page found there has a
    score, blocks whose bound is lower cannot change the first pages and are left out.
    """
    of = asked(ix, queries, languages, stem)
    spark = ix.postings.sparkSession
    ask = lambda some: given(spark, [(q,) for q in some], "query int")
    found, served, read = _by_blocks(ix, of, ask([q for q, _ in of.queries]), True, most, **filters)
    rest = [q for q, _ in of.queries if q not in set(served)]
    if rest:
        more, _, also = _by_blocks(ix, of, ask(rest), False, most, **filters)
        found, read = settle(found.unionByName(more), "found"), read.join(ask(rest), "query", "left_anti").unionByName(also)
    return found, read


def rank(ix: Index, found: DataFrame, now: int, queries: Sequence[tuple[int, Query]], limit: int = S.PAGE, offset: int = 0, recent: bool = False, whole: bool = False) -> DataFrame:
    """A page of ranked results: query, rank (from 1), id, score, mode, total, whether more follow, and the page's columns.

    The first 500 by the cheap score (or by recency) are scored exactly; any
    page past them keeps the cheap order and score 0.  ``whole``: all are scored exactly.
    """
    spark = ix.archive.sparkSession
    meta = ix.archive.select("id", "url" if "url" in ix.archive.columns else F.lit(None).cast("string").alias("url"), "title", "domain", "last_seen", "pinned", "word_count", "text")
    if recent:
        found = found.join(ix.archive.select("id", F.col("last_seen").alias("_seen")), "id")
        order = [F.desc("_seen"), F.desc("id")]
    else:
        order = [F.desc("prescore"), F.asc("id")]
    totals = found.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    head, first = F.lit(True), found
    by = order if recent else [F.desc("score"), "id"]
    if not whole:
        head = F.col("first") <= S.HEAD
        first = found.withColumn("first", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("first") <= max(S.HEAD, offset + limit))
        by = ["first"] if recent else [~head, F.when(~head, F.col("first")), *by]
    rows = first.join(meta, "id").withColumn("mean_length", statistics(ix.archive).select("mean_length").scalar())
    part = lambda p: X.term_score(p["tf"], p["idf"], F.col("word_count"), F.col("mean_length")) * F.when(p["wide"], S.WIDENED).otherwise(1.0)
    bm25 = F.aggregate("parts", F.lit(0.0), lambda a, p: a + part(p))
    typed = given(spark, [(q, list(p.lookup)) for q, p in queries], "query int, typed array<string>")
    boost = 1 + S.TITLE_BOOST * F.size(F.array_intersect("typed", X.terms(F.col("title"))))
    score = bm25 * boost * X.recency(F.col("last_seen"), now) * F.when(F.col("pinned"), S.PINNED_BOOST).otherwise(1.0)
    scored = rows.join(typed, "query").withColumn("score", F.when(head, score).otherwise(0.0))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by)))
    page = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    more = (F.lit(offset + limit) < F.col("total")).alias("has_more")
    return page.join(F.broadcast(totals) if len(queries) <= 300_000 else totals, "query").select("query", "rank", "id", "score", "mode", "total", more, "url", "title", "domain", "last_seen", "pinned", "text")


def facets(ix: Index, found: DataFrame) -> DataFrame:
    """Domains of the first 500: (query, domain, n), the eight most frequent, ties by first appearance."""
    head = found.withColumn("first", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("prescore"), "id"))).where(F.col("first") <= S.HEAD)
    by = head.join(ix.archive.select("id", "domain"), "id").groupBy("query", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("at"))
    top = by.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "at"))).where(F.col("_r") <= S.FACETS)
    return top.select("query", "domain", "n")


def first_pages(ix: Index, queries: Sequence[tuple[int, Query]], now: int, limit: int = S.PAGE, **filters) -> DataFrame:
    """The first page of ``search`` without the total, for which only blocks that can reach the first 500 are read."""
    found, _ = top(ix, queries, **filters)
    return rank(ix, found, now, queries, limit).drop("total", "has_more", "text")


def search(ix: Index, queries: Sequence[tuple[int, Query]], now: int, limit: int = S.PAGE, offset: int = 0, recent: bool = False, snippets: bool = False, whole: bool = False, **filters) -> DataFrame:
    found = candidates(ix, queries, whole=whole, **filters)
    page = rank(ix, found, now, queries, limit, offset, recent, whole)
    if not snippets:
        return page.drop("text")
    spark = ix.archive.sparkSession
    some = [q for q in queries if not q[1].empty]
    more = filters.get("languages", ()), filters.get("stem")
    shown = resolve(nearby(ix.dictionary, some, *more), words_table(spark, some), *more, whole)
    marks = shown.groupBy("query").agg(F.array_distinct(F.concat(F.collect_set("word"), F.collect_set("term"))).alias("marks"))
    return page.join(small(settle(marks, "marks")), "query").withColumn("snippet", snippet_udf("text", "marks")).drop("text", "marks")


def quality(page: DataFrame, known: DataFrame) -> DataFrame:
    """One row over known-item queries (query, id): mean reciprocal rank, share among the first three, and how many; an item not found counts 0."""
    at = known.join(page.select("query", "id", "rank"), ["query", "id"], "left")
    top3 = F.avg(F.when(F.col("rank") <= 3, 1.0).otherwise(0.0))
    return at.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), top3.alias("top3"), F.count(F.lit(1)).alias("queries"))
