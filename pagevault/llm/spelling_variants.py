"""Spelling variants: words one edit apart, grouped under the commoner word.

Words are maximal runs of Latin letters, A-Z lower-cased, of ``MIN_LENGTH`` code
points and ``MIN_COUNT`` occurrences at least.  Two words are near if one
inserted, deleted or replaced code point turns one into the other.  A word's
form is its near word of largest count (ties: smallest in code-point order), if
that count is ``RATIO`` times its own or more; its root is where its forms lead.

1. Texts are cut into words by built-in expressions; words are counted before
   any shuffle.
2. Bigrams are ordered by the number of places they stand at, the rarest first
   (ties: by their letters).  One edit spoils at most two of a word's bigrams, so
   of its three rarest at least one stands in every near word, and among that
   word's three rarest.  (Further places of the third bigram belong to the three:
   else, of equal bigrams, the wrong place might be cut off.)
3. The edit lies on one side of a bigram that stays, so on its other side the
   words are equal, letter by letter and place by place.  That is the position
   limit, and it makes the join an equi-join.  The side with the edit has a half
   without it, which joins the key, and so does the length of the shorter word
   (each word is looked for as the shorter and as the longer of two).
4. What meets is verified by edit distance and made distinct.

Scale: the text is read once; what is shuffled is words and their counts, then
some 24 hashed keys a word.  A key holds more than half of a word and its length,
so its bucket stays small however large the vocabulary, and a hot word is one
row with a large count.
Roots are found by pointer doubling: counts at least double along forms, so paths are
as long as the logarithm of the largest count, and rounds the logarithm of that.

Defined results: null texts hold no words; a null id is an id like others where
ids matter (``misspelt``); repeated rows count as often as they stand; an empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm.store import col, discard, settle, small, table

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
RAREST = 3  # bigrams by which a word is looked for: one more than one edit can spoil


def runs(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Every occurrence of a word: ``id``, ``run``, lower-cased in A-Z only."""
    found = F.regexp_extract_all(F.translate(col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]+"), 0)
    return docs.select(col(id).alias("id"), F.explode(found).alias("run"))


def misspelt(words: DataFrame, every: int = 97) -> DataFrame:
    """``runs`` with one code point less where the checksum of id and run is a multiple of ``every`` (never for a null id)."""
    h = F.crc32(F.concat_ws(":", F.col("id").cast("string"), "run").cast("binary"))
    at = F.expr("int(h % nullif(length(run), 0))")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return words.withColumn("h", F.when(F.col("id").isNotNull(), h)).select("id", F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words and their counts: ``word``, ``n``."""
    counted = words.where(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def rarest(vocab: DataFrame) -> DataFrame:
    """The places of each word's rarest bigrams: ``word``, ``at``."""
    grams = vocab.select("word", F.posexplode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("at", "gram"))
    common = settle(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), "bigrams")  # at most the square of the alphabet
    placed = grams.join(small(common), "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "at"))).alias("g"))
    last = F.col("g")[RAREST - 1]["gram"]
    return placed.select("word", F.explode(F.filter("g", lambda x, i: (i < RAREST) | (x["gram"] == last))).alias("c")).select("word", F.col("c.at").alias("at"))


def keys(places: DataFrame) -> DataFrame:
    """The parts of words by which near words find each other: ``key``, ``word``, and ``role``, 1 where the word is taken as the longer of two.

    A key is a hash of the equal side of a rare bigram, half of the other side, and the shorter word's length.
    """
    size = F.length("word")
    rows = places.select("word", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    rows = rows.withColumn("size", size - F.col("role")).withColumn("held", F.when(F.col("side") == 0, F.col("at") + 2).otherwise(size - F.col("at")))
    rows = rows.withColumn("open", F.col("size") - F.col("held")).where("open >= 0").withColumn("half", F.expr("open div 2"))
    first = lambda n: F.substring(F.col("word"), F.lit(1), n.cast("int"))
    final = lambda n: F.substring(F.col("word"), (size - n + 1).cast("int"), n.cast("int"))
    held, half, rest = F.col("held"), F.col("half"), F.col("open") - F.col("half")
    key = lambda kind, near, far: F.xxhash64(F.lit(kind), "side", "size", "held", near, far)
    by = F.when(F.col("side") == 0, F.array(key(0, first(held + half), F.lit("")), key(1, first(held), final(rest)))).otherwise(F.array(key(0, final(held + half), F.lit("")), key(1, final(held), first(rest))))
    return rows.select(F.explode(by).alias("key"), "role", "word")


def near(vocab: DataFrame) -> DataFrame:
    """Every pair of near words once: ``a`` < ``b``."""
    held = keys(rarest(vocab))
    one, two = held.where("role = 0").select("key", F.col("word").alias("a")), held.select("key", "role", F.col("word").alias("b"))
    met = one.join(two, "key").where((F.col("role") == 1) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of a settled vocabulary: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``."""
    pairs = settle(near(vocab), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = both.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = ranked.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    whole = vocab.join(best, F.col("word") == F.col("a"), "left").withColumn("takes", -F.col("best.m") >= ratio * F.col("n"))
    whole = whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best.b")).alias("form"), F.when(F.col("takes"), -F.col("best.m")).alias("form_n"))
    whole = settle(whole, "forms")
    discard(pairs)
    return whole.join(roots(whole.where("form IS NOT NULL").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) rows without a cycle, one a word, to (word, root): pointers are doubled until none leads on."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        moved = new.where("moved").limit(1).count()
        now = new.select("word", "root")
        now._settled = new._settled
        if not moved:
            return now


def spelling_variants(docs: DataFrame, text: str = "text", id: str = "doc_id", every: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The words of all texts with their forms and roots; ``every`` plants misspellings (``misspelt``)."""
    words = runs(docs, text, id)
    return grouped(settle(vocabulary(misspelt(words, every) if every else words, min_length, min_count), "vocabulary"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), every=97).select("word", "form", "root", "n", "n_near", "form_n")


# Two words differ by one replaced code point if they agree without it at its place; by an inserted one if one of them
# without some code point is the other.  crc32 is built from its polynomial: a table of 256 values, then a fold over bytes.
SQL_TEXT = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS times, doc_id || ':' || run AS said FROM r GROUP BY ALL),
h AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(said))), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
x AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS k FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
best AS (SELECT a, count(*) AS n_near, arg_min(struct_pack(b := b, m := v.n), struct_pack(m := -v.n, b := b)) AS f FROM near JOIN v ON v.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN f.m >= {RATIO} * n THEN f.b END AS form, CASE WHEN f.m >= {RATIO} * n THEN f.m END AS form_n FROM v LEFT JOIN best ON word = a),
walk AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, walk.root FROM f JOIN walk ON f.form = walk.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN walk USING (word)
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
SQL = {"op13_spelling_variants": SQL_TEXT}
