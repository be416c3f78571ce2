"""Parameter grids and reports.  A grid is a short list, so all its cells come from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.special import safe_div
from tallyloom.operators.labelsets import _n, _unpivot
from tallyloom.operators.windows import quantile_bins


def labels_by_threshold(rows: DataFrame, scores: Column, classes: list[str], cuts: list[float], *keep: str) -> DataFrame:
    """keep, theta, label: the class with the largest score above each cut (ties to the first), null below it."""
    named = F.arrays_zip(F.array(*map(F.lit, classes)).alias("c"), scores.alias("s"))

    def best(cut: float) -> Column:
        over = F.filter(named, lambda x: x["s"] > cut)
        top = F.array_max(F.transform(over, lambda x: x["s"]))
        return F.get(F.filter(over, lambda x: x["s"] == top)["c"], F.lit(0))

    cells = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("theta"), best(t).alias("label")) for t in cuts)))
    return rows.select(*keep, cells.alias("x")).select(*keep, "x.theta", "x.label")


def threshold_report(labelled: DataFrame) -> DataFrame:
    """theta, n, n_labelled, coverage, n_classes of ``labels_by_threshold``'s rows."""
    g = labelled.groupBy("theta").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.countDistinct("label").alias("n_classes"))
    return g.withColumn("coverage", F.col("n_labelled") / F.col("n"))


def agreement_with(labelled: DataFrame, key: str, reference: float) -> DataFrame:
    """theta, n, same, kappa against the labels of the reference cut; no label is a label of its own."""
    ref = labelled.where(F.col("theta") == reference).select(key, F.coalesce("label", F.lit("-")).alias("ref"))
    cells = labelled.select(key, "theta", F.coalesce("label", F.lit("-")).alias("label")).join(ref, key).groupBy("theta", "label", "ref").agg(F.count(F.lit(1)).alias("n"))
    a = cells.groupBy("theta", F.col("label").alias("l")).agg(F.sum("n").alias("na"))
    b = cells.groupBy("theta", F.col("ref").alias("l")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, ["theta", "l"]).groupBy("theta").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("s"))
    t = cells.groupBy("theta").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("ref"), F.col("n")).otherwise(0)).alias("same")).join(chance, "theta", "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("s", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return t.select("theta", "n", "same", F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)).alias("kappa"))


def adjacent_changes(labelled: DataFrame, key: str) -> DataFrame:
    """theta, n_changed: documents whose label differs from that of the next lower cut."""
    w = Window.partitionBy(key).orderBy("theta")  # a few cuts for each document
    x = labelled.withColumn("_before", F.lag("label").over(w)).withColumn("_rank", F.row_number().over(w)).where("_rank > 1")
    return x.groupBy("theta").agg(_n(~F.col("label").eqNullSafe(F.col("_before"))).alias("n_changed"))


def rerank_grid(rows: DataFrame, true: Column, scores: Column, boosts: Column, labels: list[str], lams: list[float], taus: list[float], main: Column | None = None) -> DataFrame:
    """lam, tau, macro_f1, main_preserved for every cell: a label counts if its score plus lam times its boost exceeds 0.5 + tau."""
    k = range(len(labels))
    has = [F.array_contains(true, c) for c in labels]
    cells = [(lam, tau) for lam in lams for tau in taus]
    sums = []
    for g, (lam, tau) in enumerate(cells):
        on = [F.get(scores, F.lit(i)) + lam * F.get(boosts, F.lit(i)) > 0.5 + tau for i in k]
        for i in k:
            sums += [_n(has[i] & on[i]).alias(f"t{g}_{i}"), _n(~has[i] & on[i]).alias(f"p{g}_{i}"), _n(has[i] & ~on[i]).alias(f"n{g}_{i}")]
        if main is not None:
            kept = F.coalesce(*(F.when(main == c, on[i]) for i, c in enumerate(labels)), F.lit(False))
            sums.append(F.avg(F.when(kept, 1.0).otherwise(0.0)).alias(f"m{g}"))
    one = rows.agg(*sums)
    f1 = lambda g, i: safe_div(2 * F.col(f"t{g}_{i}"), 2 * F.col(f"t{g}_{i}") + F.col(f"p{g}_{i}") + F.col(f"n{g}_{i}"))
    out = []
    for g, (lam, tau) in enumerate(cells):
        macro = sum((f1(g, i) for i in k), F.lit(0.0)) / len(labels)
        out.append(F.struct(F.lit(float(lam)).alias("lam"), F.lit(float(tau)).alias("tau"), macro.alias("macro_f1"), (F.col(f"m{g}") if main is not None else F.lit(None).cast("double")).alias("main_preserved")))
    return _unpivot(one, out)


def best_cell(grid: DataFrame, feasible: float = 0.8) -> DataFrame:
    """The cell with the best macro F1 among those that keep the main label often enough (all, if none does); ties to small lam, then tau."""
    ok = F.coalesce(F.col("main_preserved") >= feasible, F.lit(True)).cast("int")
    return grid.orderBy(F.desc(ok), F.desc(F.round("macro_f1", 9)), "lam", "tau").limit(1)


def accuracy_grid(rows: DataFrame, truth: Column, classes: list[str], variants: dict[str, Column]) -> DataFrame:
    """variant, accuracy: how often the first largest probability of each variant is the true class."""
    names = F.array(*map(F.lit, classes))
    top = lambda p: F.get(names, F.array_position(F.transform(p, lambda x: F.round(x, 9)), F.array_max(F.transform(p, lambda x: F.round(x, 9)))).cast("int") - 1)
    one = rows.agg(*(F.avg(F.when(top(p) == truth, 1.0).otherwise(0.0)).alias(f"v{i}") for i, p in enumerate(variants.values())))
    return _unpivot(one, [F.struct(F.lit(v).alias("variant"), F.col(f"v{i}").alias("accuracy")) for i, v in enumerate(variants)])


def quartile_report(rows: DataFrame, value: str, labels: Column) -> DataFrame:
    """bin, n, mean_labels, share_multi by quarters of a value."""
    size = F.size(labels)
    binned = quantile_bins(rows.withColumn("_size", size), value, 4)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_size").alias("mean_labels"), F.avg(F.when(F.col("_size") > 1, 1.0).otherwise(0.0)).alias("share_multi"))


def exclusion_bounds(rows: DataFrame, included: Column, hit: Column) -> DataFrame:
    """One row: n_all, n, observed share, and the shares if all excluded rows were misses or hits."""
    t = rows.agg(F.count(F.lit(1)).alias("n_all"), _n(included).alias("n"), _n(included & hit).alias("h"))
    return t.select("n_all", "n", safe_div(F.col("h"), F.col("n")).alias("observed"), (F.col("h") / F.col("n_all")).alias("low"), ((F.col("h") + F.col("n_all") - F.col("n")) / F.col("n_all")).alias("high"))


def tier_stats(rows: DataFrame, tier: Column, value: str) -> DataFrame:
    """tier, n, n_positive, mean, sd (population), q25, median, q75."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy(tier.alias("tier")).agg(F.count(value).alias("n"), _n(F.col(value) > 0).alias("n_positive"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), q.alias("_q"))
    return g.select("tier", "n", "n_positive", "mean", "sd", *(F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))))


def mean_table(rows: DataFrame, item: Column, grp: str, value: str, classes: list) -> DataFrame:
    """item, one mean a class (0 where empty), overall (the mean of the class means)."""
    avg = [F.coalesce(F.avg(F.when(F.col(grp) == c, F.col(value))), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(classes)]
    t = rows.groupBy(item.alias("item")).agg(*avg)
    return t.withColumn("overall", sum((F.col(f"m{i}") for i in range(1, len(classes))), F.col("m0")) / len(classes))


def fdr_report(stats: DataFrame, p: str, q: str, alphas: list[float]) -> DataFrame:
    """alpha, n_raw, n_fdr, n_dropped: significant words before and after the correction."""
    one = stats.agg(*(x for i, a in enumerate(alphas) for x in (_n(F.col(p) < a).alias(f"r{i}"), _n(F.col(q) < a).alias(f"q{i}"))))
    return _unpivot(one, [F.struct(F.lit(float(a)).alias("alpha"), F.col(f"r{i}").alias("n_raw"), F.col(f"q{i}").alias("n_fdr"), (F.col(f"r{i}") - F.col(f"q{i}")).alias("n_dropped")) for i, a in enumerate(alphas)])


def word_trials(docs: DataFrame, tokens: Column, label: str, bridges: DataFrame) -> DataFrame:
    """word, trials (documents with it), hits (of one of its two classes), lift against the classes' share of all documents."""
    totals = docs.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_k"))
    n = totals.agg(F.sum("_k").alias("_n"))
    b = bridges.select("word", "primary", "secondary")
    sides = b.select("*", F.explode(F.array_distinct(F.array("primary", "secondary"))).alias("_l"))
    prior = sides.join(totals, "_l").groupBy("word", "primary", "secondary").agg(F.sum("_k").alias("_pk")).join(F.broadcast(n))  # one row
    words = docs.select(label, F.explode(F.array_distinct(tokens)).alias("word")).join(prior, "word")
    hit = (F.col(label) == F.col("primary")) | (F.col(label) == F.col("secondary"))
    g = words.groupBy("word", "_pk", "_n").agg(F.count(F.lit(1)).alias("trials"), _n(hit).alias("hits"))
    return g.select("word", "trials", "hits", ((F.col("hits") / F.col("trials")) / (F.col("_pk") / F.col("_n"))).alias("lift"))


def recommend(report: DataFrame, weights: dict[str, float], key: str = "theta") -> DataFrame:
    """key, score: a weighted sum of columns in [0, 1], rounded to 4 places; the best first, ties to the smaller key."""
    score = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return report.select(key, F.round(score, 4).alias("score")).orderBy(F.desc("score"), key)
