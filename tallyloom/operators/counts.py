"""Document-word tables and zero-filled count tables.

A count table has one row for each word and class: word, grp, cnt.  Words are aggregated first; classes are a
fixed short list, so zero filling is one ``groupBy(word)`` with a conditional sum for each class and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_words(docs: DataFrame, tokens: Column, *keep: str, distinct: bool = True) -> DataFrame:
    """The ``keep`` columns with each (distinct) token of a document."""
    return docs.select(*keep, F.explode(F.array_distinct(tokens) if distinct else tokens).alias("word"))


def wide_counts(words: DataFrame, classes: list[str], grp: str = "grp", min_total: int = 0, weight: Column | None = None) -> DataFrame:
    """word, c0..cK-1, total: one row per word, one shuffle; ``words`` has a row per counted occurrence."""
    w = F.lit(1) if weight is None else weight
    zero = F.lit(0) if weight is None else F.lit(0.0)
    sums = [F.sum(F.when(F.col(grp) == c, w).otherwise(zero)).alias(f"c{i}") for i, c in enumerate(classes)]
    known = words.where(F.col(grp).isin(classes))
    out = known.groupBy("word").agg(*sums).withColumn("total", sum((F.col(f"c{i}") for i in range(1, len(classes))), F.col("c0")))
    return out.where(F.col("total") >= min_total) if min_total else out


def long_counts(wide: DataFrame, classes: list[str]) -> DataFrame:
    """word, grp, cnt with every class of every word."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("grp"), F.col(f"c{i}").alias("cnt")) for i, c in enumerate(classes))))
    return wide.select("word", each.alias("x")).select("word", "x.grp", "x.cnt")


def doc_counts(docs: DataFrame, tokens: Column, grp: str, classes: list[str], min_total: int = 5) -> DataFrame:
    """Numbers of documents that contain a word, by class (wide)."""
    return wide_counts(doc_words(docs, tokens, grp), classes, grp, min_total)


def token_counts(docs: DataFrame, tokens: Column, grp: str, classes: list[str], min_total: int = 8) -> DataFrame:
    """Numbers of occurrences of a word, by class (wide)."""
    return wide_counts(doc_words(docs, tokens, grp, distinct=False), classes, grp, min_total)


def both_counts(docs: DataFrame, tokens: Column, grp: str, classes: list[str], min_total: int = 5) -> DataFrame:
    """Document counts (wide) and t0..tK-1, the numbers of occurrences by class, from one pass over the tokens."""
    as_rows = lambda ws, first: F.transform(ws, lambda w: F.struct(w.alias("word"), F.lit(first).alias("first")))
    marked = F.concat(as_rows(F.array_distinct(tokens), True), as_rows(tokens, False))
    words = docs.where(F.col(grp).isin(classes)).select(grp, F.explode(marked).alias("x")).select(grp, "x.word", "x.first")
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    cells = [x for i, c in enumerate(classes) for x in (n((F.col(grp) == c) & F.col("first"), f"c{i}"), n((F.col(grp) == c) & ~F.col("first"), f"t{i}"))]
    out = words.groupBy("word").agg(*cells).withColumn("total", sum((F.col(f"c{i}") for i in range(1, len(classes))), F.col("c0")))
    return out.where(F.col("total") >= min_total) if min_total else out


def main_and_sub_counts(docs: DataFrame, tokens: Column, main: Column, subs: Column, classes: list[str]) -> DataFrame:
    """word, m0..mK-1, s0..sK-1: numbers of documents whose main class, and of whose other classes one, is each class."""
    labelled = docs.select(main.alias("_main"), F.array_except(F.array_distinct(subs), F.array(main)).alias("_subs"), F.explode(F.array_distinct(tokens)).alias("word"))
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    return labelled.groupBy("word").agg(*(x for i, c in enumerate(classes) for x in (n(F.col("_main") == c, f"m{i}"), n(F.array_contains("_subs", c), f"s{i}"))))


def weighted(both: DataFrame, alpha: float, classes: list[str], min_total: float = 8) -> DataFrame:
    """:func:`weighted_counts` from :func:`main_and_sub_counts`, for any alpha."""
    cells = [(F.col(f"m{i}") + F.lit(float(alpha)) * F.col(f"s{i}")).alias(f"c{i}") for i in range(len(classes))]
    out = both.select("word", *cells).withColumn("total", sum((F.col(f"c{i}") for i in range(1, len(classes))), F.col("c0")))
    return out.where(F.col("total") >= min_total)


def weighted_counts(docs: DataFrame, tokens: Column, main: Column, subs: Column, alpha: float, classes: list[str], min_total: float = 8) -> DataFrame:
    """Document counts with weight 1 for the main class and alpha for each other one (wide)."""
    labels = F.array_union(
        F.array(F.struct(main.alias("grp"), F.lit(1.0).alias("w"))),
        F.transform(F.array_except(F.array_distinct(subs), F.array(main)), lambda s: F.struct(s.alias("grp"), F.lit(float(alpha)).alias("w"))),
    )
    weighted = docs.withColumn("_labels", F.explode(labels)).select("_labels.grp", "_labels.w", F.explode(F.array_distinct(tokens)).alias("word"))
    return wide_counts(weighted, classes, "grp", min_total, F.col("w"))
