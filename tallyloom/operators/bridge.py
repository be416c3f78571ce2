"""Bridge words: words whose two leading classes are close to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import BRIDGE_CONFIGS, BRIDGE_MIN_COUNT, BRIDGE_MIN_LOGODDS, DELTA_GRID, REFERENCE_DELTA
from tallyloom.functions.special import t_two_sided
from tallyloom.operators.assoc import top2


def is_bridge(config: tuple[float, float, float], count_min: int = 0) -> Column:
    """The rule on top2's columns; comparisons are on raw doubles, p1 - p2 in that order."""
    p1, p2, gap = (F.lit(float(x)) for x in config)
    rule = (F.col("p1") >= p1) & (F.col("p2") >= p2) & (F.col("p1") - F.col("p2") <= gap)
    return rule & (F.col("n1") >= count_min) & (F.col("n2") >= count_min) if count_min else rule


def prob_bridge(wide: DataFrame, classes: list[str], config: tuple[float, float, float] = BRIDGE_CONFIGS["B0"], count_min: int = BRIDGE_MIN_COUNT, odds: DataFrame | None = None, logodds_min: float | None = None, z_min: float | None = None) -> DataFrame:
    """word, primary, secondary, p1, p2, gap; with ``odds`` minima on both classes' log-odds or z as well."""
    out = top2(wide, classes).where(is_bridge(config, count_min))
    if odds is not None and (logodds_min is not None or z_min is not None):
        for side in ("primary", "secondary"):
            o = odds.select("word", F.col("grp").alias(side), F.col("log_odds").alias(f"_l{side}"), F.col("z").alias(f"_z{side}"))
            out = out.join(o, ["word", side])
            if logodds_min is not None:
                out = out.where(F.col(f"_l{side}") >= logodds_min)
            if z_min is not None:
                out = out.where(F.col(f"_z{side}") >= z_min)
    return out.select("word", "primary", "secondary", "p1", "p2", "gap")


def ratio_bridge(wide: DataFrame, classes: list[str], threshold: float = 0.6) -> DataFrame:
    """The words whose second share is at least ``threshold`` of the first."""
    t = top2(wide, classes)
    return t.where(F.try_divide("p2", "p1") >= threshold).select("word", "primary", "secondary", "p1", "p2")


def delta_bridge(odds: DataFrame, delta: float = REFERENCE_DELTA, min_logodds: float = BRIDGE_MIN_LOGODDS, min_count: int = BRIDGE_MIN_COUNT, min_total: int | None = None, z_min: float | None = None, positive: bool = True, strict_z: bool = True) -> DataFrame:
    """word, primary, secondary, l1, l2, total: the two largest log-odds are large enough and closer than delta.

    ``positive``: both above 0; ``min_total``: the word's count over all classes; ``z_min``: both classes' z, where an
    infinite or missing z fails with ``strict_z`` and passes without.
    """
    finite = odds.where(~F.isnan("log_odds") & (F.abs("log_odds") < float("inf")))
    s = finite.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-F.col("log_odds")).alias("neg"), "rank", "grp", "log_odds", "cnt", "z"))).alias("s"), F.sum("cnt").alias("total"))  # one entry a class
    s = s.select("word", "total", *(F.get("s", F.lit(i))[c].alias(f"{c}{i}") for i in (0, 1) for c in ("grp", "log_odds", "cnt", "z")))
    good = F.col("log_odds0") - F.col("log_odds1") < delta
    for i in (0, 1):
        l, z = F.col(f"log_odds{i}"), F.col(f"z{i}")
        good = good & (l >= float(min_logodds)) & (F.col(f"cnt{i}") >= min_count)
        if positive:
            good = good & (l > 0)
        if z_min is not None:
            known = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
            good = good & (F.when(known, z >= z_min).otherwise(F.lit(not strict_z)))
    if min_total is not None:
        good = good & (F.col("total") >= min_total)
    return s.where(good).select("word", F.col("grp0").alias("primary"), F.col("grp1").alias("secondary"), F.col("log_odds0").alias("l1"), F.col("log_odds1").alias("l2"), "total")


def config_flags(wide: DataFrame, classes: list[str], configs: dict[str, tuple[float, float, float]] = BRIDGE_CONFIGS, count_min: int = BRIDGE_MIN_COUNT) -> DataFrame:
    """word, one 0/1 column for each configuration, n_configs: the presence matrix in one pass."""
    t = top2(wide, classes).select("word", "p1", "p2", *(is_bridge(c, count_min).cast("int").alias(name) for name, c in configs.items()))
    total = sum((F.col(c) for c in list(configs)[1:]), F.col(next(iter(configs))))
    return t.withColumn("n_configs", total)


def config_ablation(stats: DataFrame, classes: list[str], configs: dict[str, tuple[float, float, float]] = BRIDGE_CONFIGS, base: str = "B0", count_min: int = BRIDGE_MIN_COUNT) -> DataFrame:
    """For each configuration: n_bridge, ratio, jaccard with ``base`` (null if both are empty) and the mean chi2 of bridges and others.

    ``stats`` is a count table with chi2; all configurations come from one aggregation.
    """
    t = top2(stats, classes).select("chi2", *(is_bridge(c, count_min).alias(name) for name, c in configs.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.col(n).alias("hit"), F.col(base).alias("ref")) for n in configs)))
    x = t.select("chi2", each.alias("x")).select("chi2", "x.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return x.groupBy("config").agg(
        n(F.col("hit")).alias("n_bridge"),
        (n(F.col("hit")) / F.count(F.lit(1))).alias("ratio"),
        F.try_divide(n(F.col("hit") & F.col("ref")).cast("double"), n(F.col("hit") | F.col("ref")).cast("double")).alias("jaccard"),
        F.avg(F.when(F.col("hit"), F.col("chi2"))).alias("chi2_bridge"),
        F.avg(F.when(~F.col("hit"), F.col("chi2"))).alias("chi2_other"),
    )


def delta_ablation(odds: DataFrame, deltas: list[float] = DELTA_GRID, ref: float = REFERENCE_DELTA, min_logodds: float = BRIDGE_MIN_LOGODDS, min_count: int = BRIDGE_MIN_COUNT) -> DataFrame:
    """delta, n_bridge, jaccard with the reference delta: one pass over the widest set."""
    wide = delta_bridge(odds, max([*deltas, ref]), min_logodds, min_count).withColumn("d", F.col("l1") - F.col("l2"))
    each = wide.select("d", F.explode(F.array(*(F.lit(float(x)) for x in deltas))).alias("delta"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit, base = F.col("d") < F.col("delta"), F.col("d") < ref
    return each.groupBy("delta").agg(n(hit).alias("n_bridge"), F.try_divide(n(hit & base).cast("double"), n(hit | base).cast("double")).alias("jaccard"))


def delta_summary(odds: DataFrame, deltas: list[float] = DELTA_GRID, ref: float = REFERENCE_DELTA, top: int = 50, **rule) -> DataFrame:
    """delta, n_bridge, ratio of all words, jaccard and jaccard_top with the reference delta.

    ``jaccard_top`` compares the ``top`` most frequent bridge words of either delta (ties by word); ``rule`` goes to
    :func:`delta_bridge`; tasks send ``top`` words of each delta at most.  Both similarities are null where neither delta has a bridge word.
    """
    cuts = sorted({*map(float, deltas), float(ref)})
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    wide = delta_bridge(odds, cuts[-1], **rule).select("word", "total", (F.col("l1") - F.col("l2")).alias("d"))
    each = wide.select("*", F.explode(F.array(*map(F.lit, cuts))).alias("delta")).where("d < delta")
    best = each.withColumn("_place", F.row_number().over(Window.partitionBy("delta").orderBy(F.desc("total"), "word"))).where(F.col("_place") <= top)
    firsts = best.groupBy("delta").agg(F.collect_list("word").alias("words"))  # ``top`` words a delta
    base = firsts.where(F.col("delta") == float(ref)).select(F.col("words").alias("base"))
    words = odds.agg(F.countDistinct("word").alias("n_words"))
    one = wide.agg(*(x for i, c in enumerate(cuts) for x in (n(F.col("d") < c).alias(f"n{i}"), n((F.col("d") < c) & (F.col("d") < ref)).alias(f"b{i}"), n((F.col("d") < c) | (F.col("d") < ref)).alias(f"e{i}")))).join(F.broadcast(words))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    cells = F.array(*(F.struct(F.lit(c).alias("delta"), F.coalesce(f"n{i}", F.lit(0)).alias("n_bridge"), F.coalesce(share(f"n{i}", "n_words"), F.lit(0.0)).alias("ratio"), share(f"b{i}", f"e{i}").alias("jaccard")) for i, c in enumerate(cuts) if c in set(map(float, deltas))))
    none = F.array().cast("array<string>")
    grid = one.select(F.explode(cells).alias("x")).select("x.*").join(firsts, "delta", "left").join(F.broadcast(base.agg(F.first("base").alias("base"))))  # one row
    mine, its = F.coalesce("words", none), F.coalesce("base", none)
    alike = F.try_divide(F.size(F.array_intersect(mine, its)).cast("double"), F.size(F.array_union(mine, its)).cast("double"))
    return grid.select("delta", "n_bridge", "ratio", "jaccard", alike.alias("jaccard_top"))


def delta_pairs(odds: DataFrame, deltas: list[float] = DELTA_GRID, **rule) -> DataFrame:
    """delta, a, b, n: bridge words of each delta by their pair of classes."""
    wide = delta_bridge(odds, max(deltas), **rule)
    each = wide.select((F.col("l1") - F.col("l2")).alias("d"), F.least("primary", "secondary").alias("a"), F.greatest("primary", "secondary").alias("b"), F.explode(F.array(*(F.lit(float(x)) for x in deltas))).alias("delta"))
    return each.where("d < delta").groupBy("delta", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _by_config(stats: DataFrame, classes: list[str], configs: dict[str, tuple[float, float, float]], count_min: int, *keep: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), is_bridge(c, count_min).alias("hit")) for n, c in configs.items())))
    return top2(stats, classes).select(*keep, each.alias("x")).select(*keep, "x.*")


def config_tests(stats: DataFrame, classes: list[str], configs: dict[str, tuple[float, float, float]] = BRIDGE_CONFIGS, count_min: int = BRIDGE_MIN_COUNT) -> DataFrame:
    """config, median chi2 of bridges and others, bridges with p below 0.05 and 0.01 and their shares, Welch's t_stat, df, p_value.

    ``stats``: a count table with chi2 and p_value.  The test needs two words on either side, else it is null.
    """
    x = _by_config(stats, classes, configs, count_min, "chi2", "p_value")
    on, off = F.when(F.col("hit"), F.col("chi2")), F.when(~F.col("hit"), F.col("chi2"))
    known = F.col("hit") & F.col("p_value").isNotNull() & ~F.isnan("p_value")
    sums = [F.sum(F.when(known & (F.col("p_value") < a), 1).otherwise(0)).alias(name) for a, name in ((0.05, "n_sig_05"), (0.01, "n_sig_01"))]
    g = x.groupBy("config").agg(
        F.percentile(on, F.lit(0.5)).alias("median_bridge"), F.percentile(off, F.lit(0.5)).alias("median_other"), *sums, F.sum(F.when(known, 1).otherwise(0)).alias("k"),
        F.count(on).alias("n1"), F.count(off).alias("n2"), F.avg(on).alias("m1"), F.avg(off).alias("m2"), F.var_samp(on).alias("s1"), F.var_samp(off).alias("s2"),
    )
    v1, v2 = F.try_divide("s1", "n1"), F.try_divide("s2", "n2")
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    t = F.when(enough, F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(v1 + v2)))
    df = F.when(enough, F.try_divide((v1 + v2) * (v1 + v2), v1 * v1 / (F.col("n1") - 1) + v2 * v2 / (F.col("n2") - 1)))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("k").cast("double")).alias(c.replace("n_", "share_"))
    out = g.select("config", "median_bridge", "median_other", "n_sig_05", "n_sig_01", share("n_sig_05"), share("n_sig_01"), t.alias("t_stat"), df.alias("df"))
    return out.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("df")))


def config_pairs(wide: DataFrame, classes: list[str], configs: dict[str, tuple[float, float, float]] = BRIDGE_CONFIGS, count_min: int = BRIDGE_MIN_COUNT) -> DataFrame:
    """config, a, b, n: bridge words of each configuration by their pair of classes."""
    x = _by_config(wide, classes, configs, count_min, "primary", "secondary").where("hit")
    return x.groupBy("config", F.least("primary", "secondary").alias("a"), F.greatest("primary", "secondary").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def stable_words(flags: DataFrame, n_configs: int) -> DataFrame:
    """word, in_all, in_majority (at least max(2, half) of the configurations), of words in any."""
    need = max(2, -(-n_configs // 2))
    return flags.where("n_configs > 0").select("word", "n_configs", (F.col("n_configs") == n_configs).alias("in_all"), (F.col("n_configs") >= need).alias("in_majority"))
