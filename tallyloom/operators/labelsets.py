"""Label sets of documents: co-occurrence, information loss, score vectors and threshold sweeps.

Class lists are short and fixed, so all class pairs come from one aggregation of conditional sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.arrays import entropy

_n = lambda c: F.sum(F.when(c, 1).otherwise(0))


def _unpivot(one: DataFrame, cells: list) -> DataFrame:
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def cooccurrence(rows: DataFrame, labels: Column, order: list[str]) -> DataFrame:
    """a, b, n, p_b_given_a for all label pairs; a label with itself counts its documents."""
    has = [F.array_contains(labels, c) for c in order]
    one = rows.agg(*(_n(has[i] & has[j]).alias(f"n{i}_{j}") for i in range(len(order)) for j in range(i, len(order))))
    n = lambda i, j: F.col(f"n{min(i, j)}_{max(i, j)}")
    k = range(len(order))
    return _unpivot(one, [F.struct(F.lit(order[i]).alias("a"), F.lit(order[j]).alias("b"), n(i, j).alias("n"), F.try_divide(n(i, j).cast("double"), n(i, i).cast("double")).alias("p_b_given_a")) for i in k for j in k])


def transitions(rows: DataFrame, main: Column, others: Column) -> DataFrame:
    """main, sub, n, p: how often a main label's documents have another label."""
    totals = rows.groupBy(main.alias("main")).agg(F.count(F.lit(1)).alias("docs"))
    pairs = rows.select(main.alias("main"), F.explode(F.array_distinct(others)).alias("sub")).where("main != sub").groupBy("main", "sub").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(totals, "main").select("main", "sub", "n", (F.col("n") / F.col("docs")).alias("p"))


def poly_rate(rows: DataFrame, labels: Column) -> DataFrame:
    """n_labels, n, share: the histogram of label numbers."""
    g = rows.groupBy(F.size(labels).cast("long").alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total)).select("n_labels", "n", (F.col("n") / F.col("t")).alias("share"))


def information_loss(rows: DataFrame, labels: Column, main: Column) -> DataFrame:
    """label, n_docs, n_lost, rate: labels that a single main label leaves out."""
    each = rows.select(main.alias("main"), F.explode(F.array_distinct(labels)).alias("label"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), _n(~F.coalesce(F.col("label") == F.col("main"), F.lit(False))).alias("n_lost")).withColumn("rate", F.col("n_lost") / F.col("n_docs"))


def composition(rows: DataFrame, labels: Column, algo: Column, by: str) -> DataFrame:
    """by, n_a, n_b, n_c: algorithm and one label; algorithm and several; no algorithm label."""
    some = F.size(algo) > 0
    return rows.groupBy(by).agg(_n(some & (F.size(labels) <= 1)).alias("n_a"), _n(some & (F.size(labels) > 1)).alias("n_b"), _n(~some).alias("n_c"))


def label_combinations(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def active(scores: Column, threshold: float) -> Column:
    """Which scores count: above 0 for a threshold of 0, else at least the threshold."""
    return F.transform(scores, (lambda s: s > 0) if threshold == 0 else (lambda s: s >= threshold))


def domain_counts(rows: DataFrame, scores: Column, k: int, thresholds: list[float]) -> DataFrame:
    """threshold, n_domains (0..k, zero-filled), n: how many of the k scores count, in one pass."""
    hits = [F.size(F.filter(active(scores, t), lambda x: x)) for t in thresholds]
    one = rows.agg(*(_n(h == m).alias(f"n{i}_{m}") for i, h in enumerate(hits) for m in range(k + 1)))
    return _unpivot(one, [F.struct(F.lit(float(t)).alias("threshold"), F.lit(m).cast("long").alias("n_domains"), F.col(f"n{i}_{m}").alias("n")) for i, t in enumerate(thresholds) for m in range(k + 1)])


def pairwise_active(rows: DataFrame, scores: Column, names: list[str], threshold: float) -> DataFrame:
    """a, b, n: both scores count; a score with itself counts documents where it alone does."""
    k, act = range(len(names)), active(scores, threshold)
    on = [F.get(act, F.lit(i)) for i in k]
    alone = F.size(F.filter(act, lambda x: x)) == 1
    one = rows.agg(*(_n(on[i] & (alone if i == j else on[j])).alias(f"n{i}_{j}") for i in k for j in k if i <= j))
    return _unpivot(one, [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"n{min(i, j)}_{max(i, j)}").alias("n")) for i in k for j in k])


def threshold_sweep(rows: DataFrame, value: str, cuts: list[float], truth: Column | None = None) -> DataFrame:
    """cut, n_pass, share[, precision, recall]: what is at or above each cut, in one pass."""
    c = F.col(value)
    sums = [_n(c >= x).alias(f"p{i}") for i, x in enumerate(cuts)]
    if truth is not None:
        sums += [_n((c >= x) & truth).alias(f"h{i}") for i, x in enumerate(cuts)] + [_n(truth).alias("t")]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    cells = []
    for i, x in enumerate(cuts):
        cell = [F.lit(float(x)).alias("cut"), F.col(f"p{i}").alias("n_pass"), ratio(f"p{i}", "n").alias("share")]
        if truth is not None:
            cell += [ratio(f"h{i}", f"p{i}").alias("precision"), ratio(f"h{i}", "t").alias("recall")]
        cells.append(F.struct(*cell))
    return _unpivot(one, cells)


def delta_entropy(rows: DataFrame, scores: Column, *keep: str) -> DataFrame:
    """The ``keep`` columns with h_multi (bits), max_share, n_active; null entropy where all scores are 0."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double"))
    p = F.when(total > 0, F.transform(scores, lambda x: x.cast("double") / total))
    return rows.select(*keep, F.when(total > 0, entropy(p)).alias("h_multi"), F.array_max(p).alias("max_share"), F.size(F.filter(scores, lambda x: x > 0)).cast("long").alias("n_active"))


def same_wrong(preds: DataFrame, key: str, truth: str, names: list[str]) -> DataFrame:
    """a, b, n, same, expected, lift: classifier pairs on rows that both get wrong, against chance agreement.

    One row per document with a prediction column for each classifier.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = preds.select(truth, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("pa"), F.col(b).alias("pb")) for a, b in pairs))).alias("x")).select(truth, "x.*")
    wrong = each.where((F.col("pa") != F.col(truth)) & (F.col("pb") != F.col(truth)))
    cells = wrong.groupBy("a", "b", "pa", "pb").agg(F.count(F.lit(1)).alias("n"))
    sa = cells.groupBy("a", "b", F.col("pa").alias("l")).agg(F.sum("n").alias("na"))
    sb = cells.groupBy("a", "b", F.col("pb").alias("l")).agg(F.sum("n").alias("nb"))
    chance = sa.join(sb, ["a", "b", "l"]).groupBy("a", "b").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("s"))
    t = cells.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("pa") == F.col("pb"), F.col("n")).otherwise(0)).alias("same")).join(chance, ["a", "b"], "left")
    expected = F.coalesce("s", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return t.select("a", "b", "n", (F.col("same") / F.col("n")).alias("observed"), expected.alias("expected"), F.try_divide(F.col("same") / F.col("n"), expected).alias("lift"))


def same_wrong_report(preds: DataFrame, truth: str, names: list[str]) -> DataFrame:
    """a, b, n, observed, marginal, pooled, conditional, lift, excess, kappa of classifier pairs on rows that both get wrong.

    Chance agreement three ways: from both classifiers' shares of wrong labels, from the shares of both together, and
    within each true class; lift, excess and kappa are against the last.  All three come from one table of counts by
    (pair, true class, two labels).
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = preds.select(F.col(truth).alias("t"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("pa"), F.col(b).alias("pb")) for a, b in pairs))).alias("x")).select("t", "x.*")
    cells = each.where((F.col("pa") != F.col("t")) & (F.col("pb") != F.col("t"))).groupBy("a", "b", "t", "pa", "pb").agg(F.count(F.lit(1)).cast("double").alias("k"))
    sides = cells.select("a", "b", "t", "k", F.explode(F.array(F.struct(F.col("pa").alias("l"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("pb").alias("l"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))).alias("s"))
    within = sides.groupBy("a", "b", "t", F.col("s.l").alias("l")).agg(F.sum(F.col("k") * F.col("s.x")).alias("na"), F.sum(F.col("k") * F.col("s.y")).alias("nb"))
    over = within.groupBy("a", "b", "l").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("m"), F.sum((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb")) / 4).alias("q"))
    inner = within.groupBy("a", "b", "t").agg(F.try_divide(F.sum(F.col("na") * F.col("nb")), F.sum("na")).alias("c")).groupBy("a", "b").agg(F.sum("c").alias("c"))
    n, o, c = F.col("n"), F.col("observed"), F.col("conditional")
    g = cells.groupBy("a", "b").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("pa") == F.col("pb"), F.col("k")).otherwise(0.0)).alias("same")).join(over, ["a", "b"]).join(inner, ["a", "b"])
    g = g.select("a", "b", "n", (F.col("same") / n).alias("observed"), (F.col("m") / (n * n)).alias("marginal"), (F.col("q") / (n * n)).alias("pooled"), (F.col("c") / n).alias("conditional"))
    return g.select("a", "b", n.cast("long").alias("n"), "observed", "marginal", "pooled", "conditional", F.try_divide(o, c).alias("lift"), (o - c).alias("excess"), F.try_divide(o - c, 1 - c).alias("kappa"))


def weighted_means(report: DataFrame, weight: str, cols: list[str]) -> DataFrame:
    """One row: the columns' means weighted by ``weight``; nulls don't count."""
    mean = lambda c: F.try_divide(F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col(weight))), F.sum(F.when(F.col(c).isNotNull(), F.col(weight))).cast("double")).alias(c)
    return report.agg(F.sum(weight).alias(weight), *map(mean, cols))


def pair_hits(docs: DataFrame, tokens: Column, main: str, others: Column, bridges: DataFrame) -> DataFrame:
    """a, b, attempts, hits, rate: of the documents with labels a (main) and b, those that hold a bridge word of the pair.

    ``bridges``: word, primary, secondary; a pair counts in either order.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    attempts = docs.withColumn("_id", F.col("doc_id")).select("doc_id", F.col(main).alias("m"), F.explode(F.array_distinct(others)).alias("s")).where("m != s").select("doc_id", *pair(F.col("m"), F.col("s")))
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens)).alias("word"))
    known = words.join(bridges.select("word", *pair(F.col("primary"), F.col("secondary"))), "word").select("doc_id", "a", "b").distinct().withColumn("hit", F.lit(1))
    j = attempts.join(known, ["doc_id", "a", "b"], "left")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("attempts"), F.count("hit").alias("hits")).withColumn("rate", F.col("hits") / F.col("attempts"))
