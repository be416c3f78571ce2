"""Exact deduplication by progressive refinement.

Documents are compared after white space is deleted.  They are grouped by normalised length, then by the hash
of a prefix, then by a full hash; every step looks only at documents whose group still has two members.  The
first pass keeps a few numbers for each document, so the later steps move keys, never texts, and the full
hash is computed from the text of surviving groups alone.  A caller who wants the digest of every document gets it
from the first pass; who stays is decided by the same steps.

Each step aggregates the documents' keys with map-side combining and only then meets the step before, group by
group.  Groups are joined back to the documents on their key; a key that holds a third of all rows has one row on
the other side, so that a skewed join partition can be split.

Defined cases: a null text counts as empty, and all texts without other characters are equal; repeated rows
(equal ids too) are documents of their own, of which each is returned, and since nothing tells them apart, all
rows with the id that stays are ``kept``, those with a null id if no other id is in their group; a null id sorts after all others;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, read_table, strip_ws, text_or_empty


def _normalised(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    d = d.select("doc_id", F.length("text").alias("n_chars"), strip_ws(F.col("text")).alias("norm"))
    return d.select("*", F.length("norm").alias("n_norm"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head"))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").select(*keys)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal documents that with the most characters stays, then the smallest id.  ``text_sha256`` is null for
    documents that no refinement step had to hash, unless ``hash_all`` asks for the digest of each; then it is
    computed in the first pass, and no text is read again.
    """
    full = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    light = ["doc_id", "n_chars", "n_norm", "head"]
    texts = _normalised(docs, id_col, text_col, prefix)
    keys = materialize(texts.select(*light, full) if hash_all else texts.select(*light))
    by_length = _repeated(keys, "n_norm")
    by_head = materialize(_repeated(keys, "n_norm", "head").join(by_length, "n_norm", "left_semi"), compact=True)
    alike = (keys if hash_all else texts).join(by_head, ["n_norm", "head"], "left_semi")
    candidates = alike if hash_all else materialize(alike.select(*light, full))
    best = F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
    groups = candidates.groupBy("n_norm", "head", "sha").agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id")).where("group_size > 1")
    groups = materialize(groups, compact=True)
    if hash_all:
        rows = keys
    else:
        single = keys.join(by_head, ["n_norm", "head"], "left_anti").withColumn("sha", F.lit(None).cast("string"))
        rows = single.unionByName(candidates)
    joined = rows.join(groups, ["n_norm", "head", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), hash_all=True)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
