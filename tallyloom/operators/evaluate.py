"""Multi-label evaluation of set columns (true, pred); every metric is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.arrays import error_type, jaccard
from tallyloom.functions.special import safe_div
from tallyloom.operators.assoc import kappa
from tallyloom.operators.labelsets import _n, _unpivot


def label_metrics(rows: DataFrame, true: Column, pred: Column, order: list[str]) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 (0 where undefined)."""
    t, p = [F.array_contains(true, c) for c in order], [F.array_contains(pred, c) for c in order]
    one = rows.agg(*(x for i in range(len(order)) for x in (_n(t[i] & p[i]).alias(f"tp{i}"), _n(~t[i] & p[i]).alias(f"fp{i}"), _n(t[i] & ~p[i]).alias(f"fn{i}"))))
    cells = []
    for i, c in enumerate(order):
        tp, fp, fn = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")
        cells.append(F.struct(F.lit(c).alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1")))
    return _unpivot(one, cells)


def overall_metrics(rows: DataFrame, true: Column, pred: Column, order: list[str]) -> DataFrame:
    """One row: n, micro_f1, macro_f1, weighted_f1, hamming, subset_accuracy, jaccard (mean over rows; 1 for empty sets)."""
    per = label_metrics(rows, true, pred, order)
    f = per.agg(
        safe_div(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"), F.avg("f1").alias("macro_f1"),
        safe_div(F.sum(F.col("f1") * (F.col("tp") + F.col("fn"))), F.sum(F.col("tp") + F.col("fn"))).alias("weighted_f1"),
    )
    wrong = F.size(F.array_except(true, pred)) + F.size(F.array_except(pred, true))
    r = rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(wrong) / (F.count(F.lit(1)) * len(order))).alias("hamming"), F.avg(F.when(wrong == 0, 1.0).otherwise(0.0)).alias("subset_accuracy"), F.avg(jaccard(true, pred)).alias("jaccard"))
    return r.join(F.broadcast(f))


def error_types(rows: DataFrame, true: Column, pred: Column) -> DataFrame:
    return rows.groupBy(error_type(true, pred).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def set_comparison(rows: DataFrame, true: Column, pred: Column) -> DataFrame:
    """One row: n, hit (any label in common), exact, jaccard (mean)."""
    both = F.size(F.array_intersect(true, pred)) > 0
    exact = (F.size(F.array_except(true, pred)) == 0) & (F.size(F.array_except(pred, true)) == 0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(both, 1.0).otherwise(0.0)).alias("hit"), F.avg(F.when(exact, 1.0).otherwise(0.0)).alias("exact"), F.avg(jaccard(true, pred)).alias("jaccard"))


def recovery(rows: DataFrame, true: Column, pred: Column, main: Column) -> DataFrame:
    """One row: n, n_lost_docs, irr: the mean share of labels beside the main one that the prediction has."""
    lost = F.filter(true, lambda c: c != main)
    back = safe_div(F.size(F.array_intersect(lost, pred)), F.size(lost), None)
    return rows.agg(F.count(F.lit(1)).alias("n"), _n(F.size(lost) > 0).alias("n_lost_docs"), F.avg(F.when(F.size(lost) > 0, back)).alias("irr"))


def pair_boundaries(rows: DataFrame, true: Column, pred: Column, order: list[str]) -> DataFrame:
    """a, b, n, n_found, rate: rows whose true set holds both labels, and how many predictions hold both; a null rate for none."""
    pairs = [(x, y) for i, x in enumerate(order) for y in order[i + 1 :]]
    both = lambda s, x, y: F.array_contains(s, x) & F.array_contains(s, y)
    one = rows.agg(*(c for i, (x, y) in enumerate(pairs) for c in (_n(both(true, x, y)).alias(f"n{i}"), _n(both(true, x, y) & both(pred, x, y)).alias(f"f{i}"))))
    return _unpivot(one, [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("n_found"), safe_div(F.col(f"f{i}"), F.col(f"n{i}"), None).alias("rate")) for i, (x, y) in enumerate(pairs)])


def class_report(rows: DataFrame, truth: str, pred: str, order: list[str]) -> DataFrame:
    """One row on single labels: n, accuracy, kappa, micro_f1, macro_f1, weighted_f1 over the classes of ``order``."""
    t, p = F.array(F.col(truth)), F.array(F.col(pred))
    f = overall_metrics(rows, t, p, order).select("micro_f1", "macro_f1", "weighted_f1")
    k = kappa(rows, F.col(truth), F.col(pred)).select("n", F.col("po").alias("accuracy"), "kappa")
    return k.join(F.broadcast(f))  # two rows of sums


def companion_boundary(rows: DataFrame, true: Column, pred: Column, main: Column, pred_main: Column) -> DataFrame:
    """One row: companion_recall (of the other labels, without the predicted main), main_preserved."""
    subs, found = F.filter(true, lambda c: c != main), F.filter(pred, lambda c: c != pred_main)
    return rows.agg(safe_div(F.sum(F.size(F.array_intersect(subs, found))), F.sum(F.size(subs))).alias("companion_recall"), F.avg(F.when(F.array_contains(pred, main), 1.0).otherwise(0.0)).alias("main_preserved"))


def ambiguity(preds: DataFrame, truth: str, names: list[str], *keep: str) -> DataFrame:
    """keep, n_wrong, all_wrong, wrong_consensus (all wrong predictions agree), level: HIGH, MODERATE or LOW."""
    all_ = F.array(*names)
    wrong = F.filter(all_, lambda p: p != F.col(truth))
    share = F.size(wrong) / len(names)
    level = F.when(share > 0.7, "HIGH").when(share > 0.4, "MODERATE").otherwise("LOW")
    return preds.select(*keep, F.size(wrong).cast("long").alias("n_wrong"), (F.size(wrong) == len(names)).alias("all_wrong"), (F.size(F.array_distinct(wrong)) == 1).alias("wrong_consensus"), level.alias("level"))


def failure_regions(rows: DataFrame, true: Column, pred: Column, *by: Column) -> DataFrame:
    """by, n, n_wrong, rate: where the predicted set is not the true one."""
    exact = (F.size(F.array_except(true, pred)) == 0) & (F.size(F.array_except(pred, true)) == 0)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _n(~exact).alias("n_wrong")).withColumn("rate", F.col("n_wrong") / F.col("n"))


def top_k_labels(scores: Column, order: list[str], cut: float, k: int) -> Column:
    """The labels whose score is at least the cut; the k best if none is."""
    named = F.arrays_zip(F.array(*map(F.lit, order)).alias("c"), scores.alias("s"))
    over = F.filter(named, lambda x: x["s"] >= cut)["c"]
    best = F.slice(F.array_sort(F.transform(named, lambda x: F.struct((-x["s"]).alias("s"), x["c"].alias("c")))), 1, k)["c"]
    return F.when(F.size(over) > 0, over).otherwise(best)
