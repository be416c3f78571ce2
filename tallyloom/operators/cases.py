"""Case reports: how labels, scores, clinical text and bridge words of labelled cases go together.

A case has doc_id, scores (array, most severe class first), gt (set), gt_main, main, subs and keywords (classes that the
clinical text names).  Class lists are short and fixed, so most reports are one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.constants import ABUSE_ORDER, MAIN_THRESHOLD, SUB_THRESHOLD
from tallyloom.functions import labels as lb
from tallyloom.functions.arrays import fenced
from tallyloom.operators.assoc import kappa

_n = lambda c: F.sum(F.when(c, 1).otherwise(0))
_share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
_same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))


def _cells(one: DataFrame, cells: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _cell(**cols: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in cols.items()))


def with_sources(cases: DataFrame, tau: int = SUB_THRESHOLD) -> DataFrame:
    """Adds sources (of each secondary label: both, score, clinical or unknown) and case_type (A to E)."""
    sources = F.transform("subs", lambda s: lb.sub_source(s, F.col("scores"), F.col("keywords"), tau))
    cases = fenced(cases.withColumn("sources", sources))
    return fenced(cases.withColumn("case_type", lb.case_type(F.col("gt_main"), F.col("main"), F.col("subs"), F.col("sources"))))


def sub_rates(cases: DataFrame) -> DataFrame:
    """n_subs, n, share of the labelled cases with so many secondary labels."""
    g = cases.where("main IS NOT NULL").groupBy(F.size("subs").cast("long").alias("n_subs")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("n_subs", "n", _share(F.col("n"), F.col("t")).alias("share"))


def sub_sources(cases: DataFrame) -> DataFrame:
    """main, sub, source, n, mean_score: where the secondary labels of labelled cases come from."""
    each = cases.where("main IS NOT NULL").select("main", "scores", F.explode(F.arrays_zip("subs", "sources")).alias("x"))
    each = each.select("main", F.col("x.subs").alias("sub"), F.col("x.sources").alias("source"), lb.score_of(F.col("x.subs"), F.col("scores")).alias("score"))
    return each.groupBy("main", "sub", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def case_types(cases: DataFrame) -> DataFrame:
    """case_type, n, share of the cases that have both a ground-truth and an algorithm label."""
    g = cases.where("gt_main IS NOT NULL AND main IS NOT NULL").groupBy("case_type").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("case_type", "n", _share(F.col("n"), F.col("t")).alias("share"))


def first_of_types(cases: DataFrame, types: list[str], k: int = 5) -> DataFrame:
    """case_type, doc_id, main, subs: the first ``k`` cases of each type by id; tasks send k of each type at most."""
    each = cases.where(F.col("main").isNotNull() & F.col("case_type").isin(types)).select("case_type", "doc_id", "main", F.array_join("subs", "|").alias("subs"))
    place = F.row_number().over(Window.partitionBy("case_type").orderBy("doc_id", "main", "subs"))
    return each.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def clinical_mentions(cases: DataFrame) -> DataFrame:
    """gt_main (null: all), n, n_multi (two classes or more), n_extra (others than the ground truth's) of labelled cases with clinical text."""
    c = cases.where("main IS NOT NULL AND trim(clinical) <> ''")
    multi, extra = F.size("keywords") >= 2, F.size(F.array_except("keywords", F.array("gt_main"))) > 0
    every = c.agg(F.count(F.lit(1)).alias("n"), _n(multi).alias("n_multi"), _n(F.col("gt_main").isNotNull() & extra).alias("n_extra"))
    each = c.where("gt_main IS NOT NULL").groupBy("gt_main").agg(F.count(F.lit(1)).alias("n"), _n(multi).alias("n_multi"), _n(extra).alias("n_extra"))
    return every.select(F.lit(None).cast("string").alias("gt_main"), "n", "n_multi", "n_extra").unionByName(each)


def extra_mentions(cases: DataFrame) -> DataFrame:
    """gt_main, extra, n: classes that clinical texts name beside the ground truth."""
    c = cases.where("main IS NOT NULL AND gt_main IS NOT NULL AND trim(clinical) <> ''")
    return c.select("gt_main", F.explode(F.array_except("keywords", F.array("gt_main"))).alias("extra")).groupBy("gt_main", "extra").agg(F.count(F.lit(1)).alias("n"))


def gt_consistency(cases: DataFrame, tau: int = SUB_THRESHOLD) -> DataFrame:
    """One row: n, the mean score of the ground-truth class, and how many other classes are active."""
    named = F.arrays_zip(F.array(*map(F.lit, ABUSE_ORDER)).alias("c"), F.col("scores").alias("s"))
    others = F.size(F.filter(named, lambda x: (x["c"] != F.col("gt_main")) & (x["s"] >= tau)))
    c = cases.where("gt_main IS NOT NULL").select(lb.score_of(F.col("gt_main"), F.col("scores")).alias("own"), others.alias("others"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("mean_own"), _n(F.col("others") >= 1).alias("n_with_other"), F.avg("others").alias("mean_other"), (100 * F.avg(F.when(F.col("others") >= 1, 1.0).otherwise(0.0))).alias("pct_with_other"))


def weakness(cases: DataFrame) -> DataFrame:
    """One row on single labels against label sets: rates of several labels, of misses and of kinds of mismatch, accuracy."""
    c = cases.where("gt_main IS NOT NULL AND main IS NOT NULL").withColumn("every", F.array_union(F.array("main"), "subs"))
    multi, wrong = F.size("every") >= 2, F.col("gt_main") != F.col("main")
    mild = F.col("gt_main").isin(ABUSE_ORDER[1:]) & F.col("main").isin(ABUSE_ORDER[1:])
    emotional = (F.col("gt_main") == ABUSE_ORDER[2]) | (F.col("main") == ABUSE_ORDER[2])
    t = c.agg(
        F.count(F.lit(1)).alias("n"), _n(multi).alias("n_multi"), F.sum(F.when(multi, F.size(F.array_except("every", "gt")))).alias("missed"), _n(wrong).alias("n_mismatch"),
        _n(wrong & mild).alias("n_mild"), _n(wrong & emotional).alias("n_emotional"), _n(wrong & F.array_contains("subs", F.col("gt_main"))).alias("n_in_sub"),
    )
    k = kappa(c, F.col("gt_main"), F.col("main")).select("kappa")
    n, w = F.col("n"), F.col("n_mismatch")
    return t.join(F.broadcast(k)).select(
        "n", "n_mismatch", _share(F.col("n_multi"), n).alias("multi_rate"), _share(F.col("missed"), F.col("n_multi")).alias("avg_missed"), _share(F.col("n_mild"), w).alias("mild_rate"),
        _share(F.col("n_emotional"), w).alias("emotional_rate"), _share(F.col("n_in_sub"), w).alias("in_sub_rate"), _share(n - w, n).alias("accuracy"), "kappa",
    )


def triangulation(entropy: DataFrame, linkage: DataFrame, weak: DataFrame) -> DataFrame:
    """layer, indicator, value (text): the numeric, linguistic and structural findings side by side.

    ``entropy``: mean_loss, n_single, n_multi; ``linkage``: mismatch_rate, rate_sub, rate_none; ``weak``: :func:`weakness`.
    """
    pct, four = (lambda c: F.format_string("%.1f%%", 100 * F.coalesce(c, F.lit(0.0)))), (lambda c: F.format_string("%.4f", F.coalesce(c, F.lit(0.0))))
    one = entropy.join(F.broadcast(linkage)).join(F.broadcast(weak.select("mild_rate", "in_sub_rate", "kappa")))
    rows = [
        ("numeric", "mean entropy loss", four(F.col("mean_loss"))), ("numeric", "single labels", F.col("n_single").cast("string")), ("numeric", "several labels", F.col("n_multi").cast("string")),
        ("linguistic", "bridge mismatch", pct(F.col("mismatch_rate"))), ("linguistic", "bridge presence with and without sub", F.concat_ws(" vs ", pct(F.col("rate_sub")), pct(F.col("rate_none")))),
        ("structural", "mismatch outside the most severe class", pct(F.col("mild_rate"))), ("structural", "ground truth among subs", pct(F.col("in_sub_rate"))), ("structural", "kappa", four(F.col("kappa"))),
    ]
    return _cells(one, [_cell(layer=F.lit(a), indicator=F.lit(b), value=v) for a, b, v in rows])


def bridge_presence(cases: DataFrame, tokens: Column, bridges: DataFrame) -> DataFrame:
    """has_sub, n, n_with, rate, mean_words: bridge words in labelled cases with and without secondary labels."""
    c = cases.where("main IS NOT NULL").select("doc_id", (F.size("subs") > 0).alias("has_sub"), F.array_distinct(tokens).alias("toks"))
    hits = c.select("doc_id", F.explode("toks").alias("word")).join(bridges.select("word"), "word", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    j = c.select("doc_id", "has_sub").join(hits, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return j.groupBy("has_sub").agg(F.count(F.lit(1)).alias("n"), _n(F.col("k") > 0).alias("n_with"), F.avg(F.when(F.col("k") > 0, 1.0).otherwise(0.0)).alias("rate"), F.avg("k").alias("mean_words"))


def bridge_mismatch(cases: DataFrame, tokens: Column, bridges: DataFrame) -> DataFrame:
    """word, n, n_mismatch, rate: bridge words in cases whose main label isn't the word's leading class."""
    c = cases.where("main IS NOT NULL").select("main", F.explode(F.array_distinct(tokens)).alias("word"))
    j = c.join(bridges.select("word", "primary"), "word")
    wrong = F.col("main") != F.col("primary")
    return j.groupBy("word").agg(F.count(F.lit(1)).alias("n"), _n(wrong).alias("n_mismatch"), F.avg(F.when(wrong, 1.0).otherwise(0.0)).alias("rate"))


def before_after(now: DataFrame, old: dict[str, float | None]) -> DataFrame:
    """metric, old, new, difference of a table of metric and value against published values; null where none was."""
    known = F.create_map(*(x for k, v in old.items() for x in (F.lit(k), F.lit(v).cast("double"))))
    before = F.element_at(known, F.col("metric"))
    return now.select("metric", before.alias("old"), F.col("value").cast("double").alias("new"), (F.col("value") - before).alias("difference"))


def no_gt_group(cases: DataFrame) -> DataFrame:
    """main (zero-filled; null: none), n, share, n_sub, n_without_text: negative cases without ground truth, shares of all of them."""
    c = cases.where("in_neg AND gt_main IS NULL")
    group = lambda name: F.col("main") == name if name else F.col("main").isNull()
    names = [*ABUSE_ORDER, None]
    one = c.agg(F.count(F.lit(1)).alias("t"), *(x for i, m in enumerate(names) for x in (_n(group(m)).alias(f"n{i}"), _n(group(m) & (F.size("subs") > 0)).alias(f"s{i}"), _n(group(m) & (F.trim("clinical") == "")).alias(f"w{i}"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _cells(one, [_cell(main=F.lit(m).cast("string"), n=zero(f"n{i}"), share=F.coalesce(_share(zero(f"n{i}"), F.col("t")), F.lit(0.0)), n_sub=zero(f"s{i}"), n_without_text=zero(f"w{i}")) for i, m in enumerate(names)])


def dataset_report(cases: DataFrame) -> DataFrame:
    """section, key, n: sizes, valence, ground truth, cardinality and label pairs of a labelled corpus."""
    labels = F.array_union(F.when(F.col("main").isNotNull(), F.array("main")).otherwise(F.array().cast("array<string>")), F.col("subs"))
    c = cases.select("valence", "gt_status", "main", F.array_sort(labels).alias("labels"))
    count = lambda df, section, key: df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")
    pairs = c.select(F.explode("labels").alias("x"), "labels").select("x", F.explode("labels").alias("y")).where("x < y")
    parts = [count(c, "valence", F.col("valence")), count(c, "gt", F.col("gt_status")), count(c.where("main IS NOT NULL"), "main", F.col("main")), count(c, "cardinality", F.size("labels")), count(pairs, "pair", F.concat_ws("|", "x", "y"))]
    out = c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("section"), F.lit("records").alias("key"), "n")
    for p in parts:
        out = out.unionByName(p)
    return out


def gt_values(cases: DataFrame, text: Column, k: int = 20, width: int = 80) -> DataFrame:
    """value, n: the ``k`` most frequent ground-truth texts, cut to ``width`` characters; ties by text."""
    v = F.substring(F.trim(text), 1, width)
    return cases.where(text.isNotNull() & (F.trim(text) != "")).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def companions(cases: DataFrame) -> DataFrame:
    """gt_main, sub, n_gt, n_with_any, n, p, density: labels beside the ground truth; density is both directions' p together."""
    c = cases.where("gt_main IS NOT NULL AND main IS NOT NULL").withColumn("others", F.array_except(F.array_union(F.array("main"), "subs"), F.array("gt_main")))
    one = c.groupBy("gt_main").agg(F.count(F.lit(1)).alias("n_gt"), _n(F.size("others") > 0).alias("n_with_any"), *(_n(F.array_contains("others", s)).alias(f"k{i}") for i, s in enumerate(ABUSE_ORDER)))
    each = one.select("gt_main", "n_gt", "n_with_any", F.explode(F.array(*(_cell(sub=F.lit(s), n=F.col(f"k{i}")) for i, s in enumerate(ABUSE_ORDER)))).alias("x")).select("gt_main", "n_gt", "n_with_any", "x.*").where("gt_main != sub")
    each = each.withColumn("p", F.col("n") / F.col("n_gt"))
    back = each.select(F.col("gt_main").alias("sub"), F.col("sub").alias("gt_main"), F.col("p").alias("q"))
    return each.join(back, ["gt_main", "sub"], "left").withColumn("density", F.col("p") + F.coalesce("q", F.lit(0.0))).drop("q")


def poly_by_main(cases: DataFrame) -> DataFrame:
    """main, n, n_poly, rate, mean_subs: cases with two labels or more, by main label."""
    c = cases.where("main IS NOT NULL")
    poly = F.size("subs") > 0
    return c.groupBy("main").agg(F.count(F.lit(1)).alias("n"), _n(poly).alias("n_poly"), F.avg(F.when(poly, 1.0).otherwise(0.0)).alias("rate"), F.avg(F.size("subs")).alias("mean_subs"))


def lost_pairs(cases: DataFrame) -> DataFrame:
    """gt_main, lost, n, docs: labels of the ground-truth set that its main label leaves out, and the cases that lose some."""
    c = cases.where("gt_main IS NOT NULL").select("gt_main", F.array_except("gt", F.array("gt_main")).alias("lost"))
    docs = c.groupBy("gt_main").agg(_n(F.size("lost") > 0).alias("docs"))
    return c.select("gt_main", F.explode("lost").alias("lost")).groupBy("gt_main", "lost").agg(F.count(F.lit(1)).alias("n")).join(docs, "gt_main")


def status_means(cases: DataFrame, value: str) -> DataFrame:
    """gt_status, n, share, mean: how ground-truth fields split, with the mean of ``value``."""
    g = cases.groupBy("gt_status").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("gt_status", "n", _share(F.col("n"), F.col("t")).alias("share"), "mean")


def tier_by_crisis(cases: DataFrame) -> DataFrame:
    """tier, crisis, n, share within the tier."""
    g = cases.groupBy("tier", "crisis").agg(F.count(F.lit(1)).alias("n"))
    t = g.groupBy("tier").agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(t), "tier").select("tier", "crisis", "n", _share(F.col("n"), F.col("t")).alias("share"))  # three tiers


def score_patterns(cases: DataFrame, tau: int = SUB_THRESHOLD) -> DataFrame:
    """tier, pattern (active classes joined), n."""
    named = F.arrays_zip(F.array(*map(F.lit, ABUSE_ORDER)).alias("c"), F.col("scores").alias("s"))
    return cases.groupBy("tier", F.array_join(F.filter(named, lambda x: x["s"] >= tau)["c"], "|").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def pairwise_shares(pairs: DataFrame, by: str) -> DataFrame:
    """a, b, share of a table a, b, n: of the row's sum (``row``) or of all (``all``); 0 where that is 0."""
    sums = pairs.groupBy("a").agg(F.sum("n").alias("t")) if by == "row" else pairs.agg(F.sum("n").alias("t"))
    joined = pairs.join(F.broadcast(sums), "a") if by == "row" else pairs.join(F.broadcast(sums))  # one row a class
    return joined.select("a", "b", F.coalesce(_share(F.col("n"), F.col("t")), F.lit(0.0)).alias("share"))


def threshold_labels(cases: DataFrame, thetas: list[int], taus: list[int]) -> DataFrame:
    """doc_id, theta, tau, main, subs, clinical_used: labels without ground truth at every pair of thresholds, in one pass.

    ``clinical_used`` says that neither a score above theta nor nothing at all gave the main label.
    """
    grid = F.array(*(F.struct(F.lit(a).alias("theta"), F.lit(b).alias("tau")) for a in thetas for b in taus))
    each = fenced(cases.select("doc_id", "scores", "clinical", F.explode(grid).alias("g")).select("doc_id", "scores", "clinical", "g.theta", "g.tau"))
    m = fenced(each.withColumn("m", lb.main_sub(None, F.col("scores"), F.col("clinical"), F.col("theta"), F.col("tau"))))
    used = F.col("m.main").isNotNull() & (F.array_max("scores") <= F.col("theta"))
    return m.select("doc_id", "theta", "tau", F.col("m.main").alias("main"), F.col("m.subs").alias("subs"), used.alias("clinical_used"))


def tau_sensitivity(labels: DataFrame, base: int = SUB_THRESHOLD) -> DataFrame:
    """tau, n, pct_sub, mean_subs, n_pairs and the Jaccard similarity with the labels at ``base`` (mean, median, population sd)."""
    every = labels.withColumn("every", F.array_union(F.array("main"), "subs")).where("main IS NOT NULL")
    at = every.where(F.col("tau") == base).select("doc_id", F.col("every").alias("ref"))
    j = every.join(at, "doc_id").withColumn("j", F.size(F.array_intersect("every", "ref")) / F.size(F.array_union("every", "ref")))
    return j.groupBy("tau").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg(F.when(F.size("subs") > 0, 1.0).otherwise(0.0))).alias("pct_sub"), F.avg(F.size("subs")).alias("mean_subs"), F.sum(F.size("subs")).alias("n_pairs"),
        F.avg("j").alias("j_mean"), F.percentile("j", F.lit(0.5)).alias("j_median"), F.stddev_pop("j").alias("j_sd"),
    )


def corpus_membership(cases: DataFrame) -> DataFrame:
    """membership, n: cases by the subcorpora that hold them (NEG, ABUSE_NEG, GT)."""
    tags = F.filter(F.array(F.when(F.col("in_neg"), "NEG"), F.when(F.col("in_neg") & F.col("main").isNotNull(), "ABUSE_NEG"), F.when(F.size("gt") > 0, "GT")), lambda x: x.isNotNull())
    return cases.groupBy(F.array_join(tags, "|").alias("membership")).agg(F.count(F.lit(1)).alias("n"))


def five_class(cases: DataFrame, none: str) -> DataFrame:
    """doc_id, label, labels: negative cases with ground truth by their set, the others that aren't negative as class ``none``."""
    neg = cases.where("in_neg AND main IS NOT NULL AND size(gt) > 0").select("doc_id", F.col("gt_main").alias("label"), F.col("gt").alias("labels"))
    rest = cases.where("NOT in_neg").select("doc_id", F.lit(none).alias("label"), F.array(F.lit(none)).alias("labels"))
    return neg.unionByName(rest)
