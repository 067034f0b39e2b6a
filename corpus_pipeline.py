"""The training-data pipeline: five stages from documents to a mixed, shuffled corpus.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder, reads
it back for the next, and removes it once that is written.

1. language: rows that no known language explains go (operator 8);
2. lines: boilerplate lines of each source are cut from the texts, ``n_chars``
   follows (operator 2, with the equal texts of a source as one page: copies are
   left for the next stage);
3. duplicates: one document of each group of near copies stays (operator 9);
4. decontamination: texts that hold benchmark items go (operator 5);
5. mixing: sources are repeated to equal weights and shuffled (operator 7).

Stages 1, 3 and 4 rest on models and hashes that SQL can't express, so there is
no ORACLE_SQL; the pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from pagevault.llm.store import discard, settle, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language_id.identify(docs)
    return judged.where((F.col("language") != language_id.UNKNOWN) & (F.col("confidence") >= language_id.CONFIDENT)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(docs, once=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("language", language), ("lines", lines), ("duplicates", duplicates), ("decontamination", decontamination), ("mixing", mixture)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*held)  # no later stage reads what an earlier one wrote
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
