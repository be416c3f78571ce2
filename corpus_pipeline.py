"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is
written and read again as the next one's docs.  All but the last return the columns of ``documents``.

* language_id keeps documents whose language is identified: texts without a letter and those below
  ``MIN_LANGUAGE_SCORE`` go.
* line_dedup takes out lines that stand on more than a tenth of a source's documents; no document goes.
* minhash_near_dedup keeps one document of each near-duplicate group (five-word shingles, similarity 0.8 or more).
* decontaminate drops documents that hold a benchmark item, edits included.
* bpe_tokens returns doc_id, n_tokens, ids and the text that the ids decode to.

Nulls: a null text has no language and goes in the first stage; a null source is a source of its own; a null id is
carried along.  Repeated rows are near duplicates, of which one stays.  An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from tallyloom.llm.common import materialize, read_table

MIN_LANGUAGE_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = langid.with_language(docs, langid.train(docs))
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(docs, F.col("source"))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each_group(docs, size=5).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark")).select(COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.bpe_encode(docs, bpe.share_vocabulary(spark, bpe.vocabulary_path()), decode=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", boilerplate_lines),
    ("minhash_near_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("bpe_tokens", bpe_tokens),
]

#: The near-duplicate components and the merges of the vocabulary are beyond SQL; the tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
