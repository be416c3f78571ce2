"""Several corpora counted at once.

Every document has a bit for each corpus that holds it.  One aggregation counts (word, bits, class); any corpus's
count table is a sum over the bits that include it, without reading the documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import assoc, bridge
from tallyloom.operators.windows import set_overlap


def membership(corpora: dict[str, Column]) -> Column:
    """The bits of the corpora whose condition holds; an unknown condition counts as false."""
    out = F.lit(0)
    for i, c in enumerate(corpora.values()):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out


def counts_by_membership(docs: DataFrame, tokens: Column, label: str, classes: list[str], corpora: dict[str, Column]) -> DataFrame:
    """word, mask, c0..cK-1: numbers of documents that hold the word, by the exact set of corpora."""
    words = docs.where(F.col(label).isin(classes)).select(label, membership(corpora).alias("mask"), F.explode(F.array_distinct(tokens)).alias("word")).where("mask > 0")
    return words.groupBy("word", "mask").agg(*(F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)))


def corpus_counts(by_mask: DataFrame, corpora: list[str], corpus: str, classes: list[str], among: list[str], min_total: int = 5) -> DataFrame:
    """word, c0.., total of one corpus over the classes ``among``, which are numbered anew."""
    kept = [classes.index(c) for c in among]
    bit = 1 << corpora.index(corpus)
    g = by_mask.where(F.col("mask").bitwiseAND(bit) > 0).groupBy("word").agg(*(F.sum(f"c{i}").alias(f"c{n}") for n, i in enumerate(kept)))
    return g.withColumn("total", sum((F.col(f"c{n}") for n in range(1, len(kept))), F.col("c0"))).where(F.col("total") >= min_total)


def diagnostic_bridges(wide: DataFrame, classes: list[str], top: int = 200) -> DataFrame:
    """Bridge words among the ``top`` words by chi-square."""
    return bridge.prob_bridge(assoc.top_chi2(assoc.word_chi2(wide, len(classes)), top), classes)


def correction_bridges(wide: DataFrame, classes: list[str], among: list[str], top: int = 200) -> DataFrame:
    """The same of a table with more classes: words chosen by their totals over all, counted and compared over ``among`` alone."""
    cs = [classes.index(c) for c in among]
    t = wide.select("word", *(F.col(f"c{i}").alias(f"c{n}") for n, i in enumerate(cs)))
    t = t.withColumn("total", sum((F.col(f"c{n}") for n in range(1, len(cs))), F.col("c0"))).where("total > 0")
    return diagnostic_bridges(t, among, top)


def bridge_overlap(diagnostic: DataFrame, correction: DataFrame) -> DataFrame:
    """One row: n_diagnostic, n_correction, n_both, ratio of both to either (0 for none)."""
    o = set_overlap(diagnostic, correction, "word")
    return o.select(F.col("n_a").alias("n_diagnostic"), F.col("n_b").alias("n_correction"), F.col("both").alias("n_both"), F.coalesce("jaccard", F.lit(0.0)).alias("ratio"))
