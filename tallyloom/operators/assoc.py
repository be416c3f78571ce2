"""Association statistics on wide count tables (word, c0..cK-1, total).

Class totals are one row; they come from one aggregation with map-side combining and are joined to the words as
a broadcast of that single row, so nothing is shuffled but the counts themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import ALPHA
from tallyloom.functions.special import chi2_sf, f_sf, safe_div, t_two_sided
from tallyloom.operators.windows import running_sum
from tallyloom.sources.scratch import written


def _add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def with_totals(wide: DataFrame, k: int) -> DataFrame:
    """Adds n0..nK-1 (class totals), n (grand total) and v (number of words): one row, broadcast."""
    sums = wide.agg(*(F.sum(f"c{i}").cast("double").alias(f"n{i}") for i in range(k)), F.sum("total").cast("double").alias("n"), F.count(F.lit(1)).alias("v"))
    return wide.join(F.broadcast(sums))


def word_chi2(wide: DataFrame, k: int, p_value: bool = False) -> DataFrame:
    """Adds chi2, the word's contribution to the table's chi-square; undefined terms count 0."""
    t = with_totals(wide, k)
    terms = []
    for i in range(k):
        e = F.col("total") * F.col(f"n{i}") / F.col("n")
        terms.append(F.coalesce(F.try_divide((F.col(f"c{i}") - e) * (F.col(f"c{i}") - e), e), F.lit(0.0)))
    out = t.withColumn("chi2", _add(terms)).select(*wide.columns, "chi2")
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), k - 1)) if p_value else out


def top_chi2(stats: DataFrame, k: int = 200) -> DataFrame:
    """The k words with the largest chi2; ties by word."""
    return stats.orderBy(F.desc("chi2"), F.asc("word")).limit(k)


def bh_fdr(rows: DataFrame, p: str = "p_value", out: str = "p_fdr_bh") -> DataFrame:
    """Benjamini-Hochberg q-values; null p-values keep a null.

    Only one row for each distinct p-value takes part in the ordered windows, which run within slices of the values:
    a value's largest rank is the number of p-values up to it, so ties share their smallest q.
    """
    counts = written(rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k")))  # read five times
    ranked = running_sum(counts, "_p", "_k", "_rank").join(F.broadcast(counts.agg(F.sum("_k").alias("_m")))).withColumn("_q", F.col("_p") * F.col("_m") / F.col("_rank"))
    after = Window.orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    later = ranked.groupBy("_slice").agg(F.min("_q").alias("_least")).select("_slice", F.min("_least").over(after).alias("_later"))  # a row a slice
    here = F.min("_q").over(Window.partitionBy("_slice").orderBy("_p").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    q = ranked.join(F.broadcast(later), "_slice").select("_p", F.least(here, F.col("_later"), F.lit(1.0)).alias(out))
    return rows.join(q, rows[p] == F.col("_p"), "left").drop("_p")


def log_odds(wide: DataFrame, classes: list[str], alpha: float = ALPHA) -> DataFrame:
    """word, grp, cnt, log_odds, se, z: smoothed log-odds of each word for each class against the rest."""
    t = with_totals(wide, len(classes))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("grp"), F.lit(i).alias("rank"), F.col(f"c{i}").alias("cnt"), F.col(f"n{i}").alias("ng")) for i, c in enumerate(classes))))
    x = t.select("word", "total", "n", "v", cells.alias("x")).select("word", "total", "n", "v", "x.*")
    a, av = F.lit(alpha), F.lit(alpha) * F.col("v")
    x = x.withColumn("p1", (F.col("cnt") + a) / (F.col("ng") + av)).withColumn("p2", (F.col("total") - F.col("cnt") + a) / (F.col("n") - F.col("ng") + av))
    good = (F.col("p1") > 0) & (F.col("p1") < 1) & (F.col("p2") > 0) & (F.col("p2") < 1)
    odds = F.ln(F.col("p1") / (1 - F.col("p1"))) - F.ln(F.col("p2") / (1 - F.col("p2")))
    se = F.sqrt(1 / (F.col("cnt") + a) + 1 / (F.col("total") - F.col("cnt") + a))
    x = x.withColumn("log_odds", F.when(good, odds).otherwise(F.lit(0.0))).withColumn("se", F.when(good, se).otherwise(F.lit(float("inf"))))
    return x.withColumn("z", F.when(good, F.col("log_odds") / F.col("se")).otherwise(F.lit(0.0))).select("word", "grp", "rank", "cnt", "log_odds", "se", "z")


def top_per_class(odds: DataFrame, n: int) -> DataFrame:
    """The n words of each class with the largest log-odds; ties by word."""
    w = Window.partitionBy("grp").orderBy(F.desc("log_odds"), F.asc("word"))
    return odds.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def main_class(odds: DataFrame) -> DataFrame:
    """Each word's class of the largest log-odds; ties to the first class."""
    return odds.groupBy("word").agg(F.max_by("grp", F.struct("log_odds", -F.col("rank"))).alias("grp"), F.max("log_odds").alias("log_odds"))


def top2(wide: DataFrame, classes: list[str]) -> DataFrame:
    """Adds primary, secondary, p1, p2, gap: the two classes with the largest shares; ties to the first class."""
    cells = F.array(*(F.struct((-F.col(f"c{i}")).alias("neg"), F.lit(i).alias("rank"), F.lit(c).alias("grp"), F.col(f"c{i}").alias("cnt")) for i, c in enumerate(classes)))
    s = wide.withColumn("_s", F.array_sort(cells))
    p = lambda i: F.col("_s")[i]["cnt"] / F.col("total")
    s = s.withColumns({"primary": F.col("_s")[0]["grp"], "secondary": F.col("_s")[1]["grp"], "p1": p(0), "p2": p(1), "n1": F.col("_s")[0]["cnt"], "n2": F.col("_s")[1]["cnt"]})
    return s.withColumn("gap", F.col("p1") - F.col("p2")).drop("_s")


def top2_entropy(wide: DataFrame, classes: list[str]) -> DataFrame:
    """top2 plus entropy (nats), log_total and top2_mass."""
    t = top2(wide, classes)
    terms = _add((F.col(f"c{i}") / F.col("total")) * F.ln(F.col(f"c{i}") / F.col("total") + 1e-12) for i in range(len(classes)))
    return t.withColumns({"entropy": -terms, "log_total": F.log1p(F.col("total")), "top2_mass": F.col("p1") + F.col("p2")})


def hhi(wide: DataFrame, classes: list[str]) -> DataFrame:
    """grp, hhi: the sum of squared word shares of each class."""
    k = len(classes)
    t = wide.agg(*(F.sum(F.col(f"c{i}").cast("double") * F.col(f"c{i}")).alias(f"q{i}") for i in range(k)), *(F.sum(f"c{i}").alias(f"n{i}") for i in range(k)))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("grp"), F.try_divide(F.col(f"q{i}"), F.col(f"n{i}").cast("double") * F.col(f"n{i}")).alias("hhi")) for i, c in enumerate(classes))))
    return t.select(cells.alias("x")).select("x.*")


def class_cosine(wide: DataFrame, classes: list[str]) -> DataFrame:
    """a, b, cosine between the classes' count columns; null for a zero column."""
    k = range(len(classes))
    t = wide.agg(*(F.sum(F.col(f"c{i}").cast("double") * F.col(f"c{j}")).alias(f"d{i}_{j}") for i in k for j in k if i <= j))
    d = lambda i, j: F.col(f"d{min(i, j)}_{max(i, j)}")
    cells = [F.struct(F.lit(classes[i]).alias("a"), F.lit(classes[j]).alias("b"), F.try_divide(d(i, j), F.sqrt(d(i, i)) * F.sqrt(d(j, j))).alias("cosine")) for i in k for j in k]
    return t.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi2 (Yates-corrected when dof is 1), dof, cramers_v and p_value of two category columns."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    r, c = ra.agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("n"), F.sum(1.0 / F.col("ra")).alias("ir")), cb.agg(F.count(F.lit(1)).alias("c"), F.sum(1.0 / F.col("cb")).alias("ic"))
    size = r.join(F.broadcast(c))  # two rows of sums
    e = F.col("ra").cast("double") * F.col("cb") / F.col("n")
    seen = cells.join(ra, a).join(cb, b).join(F.broadcast(size)).groupBy("r", "c", "n", "ir", "ic").agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("s"), F.sum(e).alias("se"), F.max(F.abs(F.col("o") - e)).alias("d"))
    # cells that don't occur add what is expected of them; of two by two cells all differ by the same
    dof, d = (F.col("r") - 1) * (F.col("c") - 1), F.col("d") - F.least(F.lit(0.5), F.col("d"))
    corrected = d * d * F.col("n") * F.col("ir") * F.col("ic")
    out = seen.select("r", "c", "n", F.when(dof == 1, corrected).otherwise(F.col("s") + F.col("n") - F.col("se")).alias("chi2"), dof.alias("dof"))
    v = F.sqrt(safe_div(F.col("chi2") / F.col("n"), F.least("r", "c") - 1))
    return out.select("n", "chi2", "dof", v.alias("cramers_v"))


def anova(rows: DataFrame, grp: str, value: str, p_value: bool = False) -> DataFrame:
    """One row: F, df1, df2 of a one-way analysis of variance."""
    g = rows.where(F.col(value).isNotNull() & F.col(grp).isNotNull()).groupBy(grp).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    out = t.select(((between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))).alias("f_stat"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
    return out.withColumn("p_value", f_sf(F.col("f_stat"), F.col("df1"), F.col("df2"))) if p_value else out


def group_stats(rows: DataFrame, grp: str, value: str) -> DataFrame:
    """grp, n, mean, std (sample)."""
    return rows.groupBy(grp).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


#: Groups that may be compared in pairs.
MAX_GROUPS = 1000


def welch(rows: DataFrame, grp: str, value: str, p_value: bool = False) -> DataFrame:
    """a, b, t_stat, df of Welch's test for every pair of groups."""
    g = rows.groupBy(grp).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("s2")).where("n > 1")
    x = g.select(F.col(grp).alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), (F.col("s2") / F.col("n")).alias("va"))
    y = g.select(F.col(grp).alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), (F.col("s2") / F.col("n")).alias("vb"))
    if g.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups to compare in pairs")
    j = x.join(F.broadcast(y), F.col("a") < F.col("b"))  # a row a group
    v = F.col("va") + F.col("vb")
    df = v * v / (F.col("va") * F.col("va") / (F.col("na") - 1) + F.col("vb") * F.col("vb") / (F.col("nb") - 1))
    out = j.select("a", "b", ((F.col("ma") - F.col("mb")) / F.sqrt(v)).alias("t_stat"), df.alias("df"))
    return out.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("df"))) if p_value else out


def kappa(rows: DataFrame, a: Column, b: Column, perfect: float = 1.0) -> DataFrame:
    """One row: n, po, pe, kappa; null is a label of its own; ``perfect`` where chance agreement is 1."""
    cells = rows.select(a.cast("string").alias("a"), b.cast("string").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    x = cells.groupBy("a").agg(F.sum("n").alias("na"))
    y = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    both = x.join(y, F.col("a").eqNullSafe(F.col("b"))).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("s"))
    t = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same")).join(F.broadcast(both))
    po, pe = F.col("same") / F.col("n"), F.coalesce("s", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return t.select("n", po.alias("po"), pe.alias("pe"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(perfect)).alias("kappa"))


def spearman(rows: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Rank correlation (average ranks) by group: one row per group.

    Ranks come from counts of distinct values, so the ordered window sees each value once.
    """
    keys = [by] if by else []

    def ranked(c: str) -> DataFrame:
        counts = rows.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias("_k"))
        if by:
            upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(by).orderBy(f"_{c}")))
        else:
            upto = running_sum(counts, f"_{c}", "_k", "_upto")
        return upto.select(*keys, f"_{c}", (F.col("_upto") - (F.col("_k") - 1) / 2).alias(f"_r{c}"))

    out = rows.select(*keys, F.col(a).alias(f"_{a}"), F.col(b).alias(f"_{b}")).join(ranked(a), [*keys, f"_{a}"]).join(ranked(b), [*keys, f"_{b}"])
    return out.groupBy(*keys).agg(F.corr(f"_r{a}", f"_r{b}").alias("rho"), F.count(F.lit(1)).alias("n"))
