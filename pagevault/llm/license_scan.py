"""License scan by diagonal voting.

Every text's rolling three-word hashes are joined with the positions of the
same hashes in license templates.  A hit votes for the diagonal (position in the
text minus position in the template); votes are aggregated by text, template and
diagonal.  A diagonal that has all grams of a phrase template is a place of that
phrase.  For license texts and notices, diagonals at most ``NEAR`` apart (a few
words were put in or left out) are merged into chains.  A chain may go on without
end, where a text repeats words of the template; so of each chain the stretch of
``STRETCH`` times the template's length that holds most of the template's grams
is verified: it must hold ``COVER`` of them.

Scale: the texts are read once.  Grams are exploded and joined inside one stage
with the templates, whose fixed size (``TEMPLATES``) is broadcast, so only hits
and one row for each text are shuffled; the votes are settled, and what follows
reads only them.  What is gathered for a diagonal is bounded by the template's
length, for a stretch by ``STRETCH`` times that.

Defined results: a null text counts as empty, with 0 words and no labels;
repeated rows get equal results, as votes are sets of positions; null ids are
told apart by their texts; an empty table gives an empty result; extra columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.store import batched, col, content, settle, table

GRAM = 3
NEAR = 4
COVER = 0.5
STRETCH = 1.5

# Phrases and their labels, then license texts and notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "warranty-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-2": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2-terms": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-reference": "licensed under the gnu general public license version",
    "lgpl-reference": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


def _hashes(text: str) -> np.ndarray:
    return W.words(np.frombuffer(text.encode(), dtype=np.uint8))[2]


MARK = 1  # stands for a gram hash in front of each text's grams, so that texts without hits keep a row


def positions(spark: SparkSession) -> DataFrame:
    """Template grams: hash, template name, position, number of grams and whether it is a phrase; and the mark."""
    rows = [(MARK, "", 0, 0, False)]
    for name, phrase in [*((p, True) for p in PHRASES), *((t, False) for t in TEMPLATES)]:
        h = W.grams(_hashes(name if phrase else TEMPLATES[name]), GRAM).view(np.int64)
        rows += [(int(x), name, i, len(h), phrase) for i, x in enumerate(h)]
    return spark.createDataFrame(rows, "_hash bigint, template string, at int, grams int, phrase boolean")


def _tokens(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Per row: key, number of words, and the mark followed by all rolling gram hashes."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = W.column_bytes(b.column(3))
            for i, j in W.blocks(offsets):
                _, _, h, at = W.block_words(raw, offsets, i, j)
                n = np.diff(at)
                size = np.maximum(0, n - GRAM + 1)
                ends = np.concatenate([[0], np.cumsum(size + 1)])
                every = np.full(ends[-1], MARK, dtype=np.int64)
                inside = np.ones(len(every), dtype=bool)
                inside[ends[:-1]] = False
                every[inside] = W.grams(h, GRAM).view(np.int64)[np.repeat(at[:-1] - (ends[:-1] - np.arange(len(n))), size) + np.arange(inside.sum())]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in b.columns[:3]), pa.array(n, type=pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(every))], names=["_id", "_a", "_b", "n_words", "grams"])

    a, b = content(col(text))
    return batched(docs).select(col(id).alias("_id"), a.alias("_a"), b.alias("_b"), col(text)).mapInArrow(run, f"_id {kind}, _a bigint, _b bigint, n_words bigint, grams array<bigint>")


KEY = ["_id", "_a", "_b"]


def diagonals(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Votes: key, words, template, diagonal, the template positions hit on it, and rows (the mark's: how many rows have the key)."""
    every = _tokens(docs, text, id).select(*KEY, "n_words", F.posexplode("grams").alias("pos", "_gram"))
    hits = every.join(F.broadcast(positions(docs.sparkSession)), F.col("_gram") == F.col("_hash")).where((F.col("pos") == 0) == (F.col("template") == ""))
    return hits.groupBy(*KEY, "n_words", "template", "phrase", "grams", (F.col("pos") - 1 - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"), F.count(F.lit(1)).alias("rows"))


def licenses(votes: DataFrame) -> DataFrame:
    """Verified spans of settled votes: key, template, phrase, first word, cover (1 for a phrase)."""
    places = votes.where(F.col("phrase") & (F.size("at") == F.col("grams"))).select(*KEY, "template", "phrase", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"))
    w = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    rest = votes.where(~F.col("phrase") & (F.col("template") != "")).withColumn("_new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > NEAR).cast("int"), F.lit(1)))
    hits = rest.withColumn("_run", F.sum("_new").over(w)).withColumn("at", F.explode("at")).withColumn("pos", F.col("diagonal") + F.col("at"))
    # the frame is as long as the template allows: positions are scaled so that its length is SCALE for all
    reach = F.floor(STRETCH * (F.col("grams") + GRAM - 1)) - GRAM
    scaled = F.floor(F.col("pos").cast("long") * SCALE / reach).cast("long")
    frame = Window.partitionBy(*KEY, "template", "_run").orderBy("_place").rangeBetween(0, SCALE)
    held = hits.withColumn("_place", scaled).withColumn("held", F.size(F.collect_set("at").over(frame)))
    best = held.groupBy(*KEY, "template", "phrase", "grams", "_run").agg(F.max(F.struct("held", (-F.col("pos")).alias("before"))).alias("best"))
    spans = best.where(F.col("best.held") >= COVER * F.col("grams"))
    return places.unionByName(spans.select(*KEY, "template", "phrase", (-F.col("best.before")).alias("start"), (F.col("best.held") / F.col("grams")).alias("cover")))


SCALE = 1_000_000


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, words, places of phrases, labels and a score from 0 to 1."""
    label = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("template")]
    only = lambda x: F.when(F.col("phrase"), x)
    votes = settle(diagonals(docs, text, id), "votes")
    texts = votes.where(F.col("template") == "").select(*KEY, F.lit(None).cast("string").alias("template"), F.lit(None).cast("boolean").alias("phrase"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("double").alias("cover"), "n_words", "rows")
    found = licenses(votes).select("*", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("rows"))
    each = texts.unionByName(found).groupBy(*KEY).agg(
        F.max("n_words").alias("n_words"), F.max("rows").alias("rows"),
        F.count(only(F.lit(1))).alias("n_base"), F.min(only(F.col("start"))).cast("long").alias("first_word"), F.max(only(F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(only(label))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(F.coalesce(only(label), F.col("template")))), ",").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    rows = each.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return rows.select(F.col("_id").alias(id), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_diagonals": op10_license_diagonals}
SQL: dict[str, str] = {}
