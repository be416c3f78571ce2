"""Ranks, bins, neighbours, folds and set operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.scratch import written

#: Slices that an ordered window over all rows is cut into.
SLICES = 64


def sliced(rows: DataFrame, order: str, n: int = SLICES) -> DataFrame:
    """Adds _slice, which grows with ``order``: the values between about equal parts, of which at most n numbers are fetched."""
    edges = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = F.array(*(F.lit(float(e)) for e in sorted(set(edges)))).cast("array<double>")
    return rows.withColumn("_slice", F.size(F.filter(cuts, lambda e: e < F.col(order))))


def running_sum(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds _slice and the sum of ``value`` up to each row in ``order``: within slices, upon the sums of the slices before."""
    s = sliced(rows, order)
    each = s.groupBy("_slice").agg(F.sum(value).alias("_sum"))
    before = each.select("_slice", (F.sum("_sum").over(Window.orderBy("_slice")) - F.col("_sum")).alias("_before"))  # a row a slice
    here = F.sum(value).over(Window.partitionBy("_slice").orderBy(order))
    return s.join(F.broadcast(before), "_slice").withColumn(out, here + F.col("_before")).drop("_before")


def exact_percentiles(rows: DataFrame, value: str, shares: list[float], slices: int = SLICES) -> list[float]:
    """Exact percentiles, linear between neighbours, without ordering all rows in one task; nulls don't count.

    Values are cut into slices; only the slices that hold the wanted places are ordered, each by itself.
    """
    s = sliced(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "v", slices)
    sizes = [(r["_slice"], r["count"]) for r in s.groupBy("_slice").count().orderBy("_slice").collect()]  # a row a slice
    n = sum(c for _, c in sizes)
    if not n:
        return [None] * len(shares)
    wanted = {int(p) for q in shares for p in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    starts, before = {}, 0
    for k, c in sizes:
        starts[k] = before
        before += c
    picks = [(k, p - starts[k] + 1, p) for k, c in sizes for p in wanted if starts[k] <= p < starts[k] + c]
    asked = rows.sparkSession.createDataFrame(picks, "_slice int, _place int, place long")
    held = s.join(F.broadcast(asked.select("_slice").distinct()), "_slice")
    placed = held.withColumn("_place", F.row_number().over(Window.partitionBy("_slice").orderBy("v")))
    at = {r.place: r.v for r in placed.join(F.broadcast(asked), ["_slice", "_place"]).collect()}  # two rows a share
    out = []
    for q in shares:
        low = math.floor(q * (n - 1))
        a, b = at[low], at[math.ceil(q * (n - 1))]
        out.append(a + (b - a) * (q * (n - 1) - low))
    return out


def quantile_bins(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Adds bin (1-based): right-closed intervals between the exact, distinct quantile edges; the lowest value is in bin 1."""
    edges = sorted({e for e in exact_percentiles(rows, value, [i / n for i in range(n + 1)]) if e is not None})
    below = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col(value))).cast("long")
    return rows.withColumn("bin", F.greatest(F.lit(1).cast("long"), below))


def neighbours(rows: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """prev, word of all neighbouring tokens of a row; no window, for the tokens are together already."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
    return rows.where(F.size(tokens) > 1).select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.prev", "x.word")


def folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: stratified, by the hash of the key, alike for any partitioning.

    The rank within a label is taken per hash bucket, so a label that holds most rows isn't ordered in one task;
    buckets start at different folds, which keeps the folds even.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    bucket = F.pmod(h, F.lit(64))
    w = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    ranked = rows.withColumns({"_hash": h, "_bucket": bucket}).withColumn("fold", ((F.row_number().over(w) - 1 + F.col("_bucket")) % k).cast("int"))
    return ranked.drop("_hash", "_bucket")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (aggregated, not windowed)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def mode_share(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, mode (ties to the value seen first in ``order``), share: how stable a value is."""
    each = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return each.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias("mode"), (F.max("_n") / F.sum("_n")).alias("share"))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_a, n_b, both, either, jaccard (null if both are empty) of two sets of keys."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full")
    n = lambda c: F.count(F.when(c, 1))
    both, either = n(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.count(F.lit(1))
    return j.agg(n(F.col("_a").isNotNull()).alias("n_a"), n(F.col("_b").isNotNull()).alias("n_b"), both.alias("both"), either.alias("either"), F.try_divide(both.cast("double"), either.cast("double")).alias("jaccard"))


def met_words(rows: DataFrame, key: str, words: str, chosen: DataFrame, least: int) -> DataFrame:
    """word, other, n: in how many rows a chosen word and another one stand together, from ``least`` rows on.

    ``words``: a row's distinct words; ``chosen``: word.  Words of fewer rows than ``least`` can be in no such pair and are left out
    first.  What is exchanged are numbers of rows by word and of words by row, and counted pairs; no row travels once a word.
    """
    at = rows.select(key, F.explode(words).alias("word"))
    often = at.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("word")
    known = often.join(chosen.select("word", F.lit(1).alias("_one")), "word", "left").select("word", (F.monotonically_increasing_id() * 2 + F.coalesce("_one", F.lit(0))).alias("id"))
    known = written(known)
    lists = at.groupBy("word", F.spark_partition_id().alias("_part")).agg(F.collect_list(key).alias("rows"))  # of one task's rows
    ids = lists.join(known, "word").select("id", F.explode("rows").alias("row")).groupBy("row").agg(F.collect_list("id").alias("ids"))
    pairs = ids.select(F.explode(F.filter("ids", lambda i: i.bitwiseAND(F.lit(1)) == 1)).alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a <> b")
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    name = lambda c: known.select(F.col("id").alias(c), F.col("word").alias({"a": "word", "b": "other"}[c]))
    return n.join(name("a"), "a").join(name("b"), "b").select("word", "other", "n")
