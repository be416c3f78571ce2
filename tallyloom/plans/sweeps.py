"""Queries on parameter grids and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.constants import BRIDGE_CONFIGS
from tallyloom.operators import assoc, bridge, counts, oversight, sweeps
from tallyloom.plans import base as b
from tallyloom.plans.models import _BR, _bridges
from tallyloom.plans.sets import _MAIN, _S, _main, _scores
from tallyloom.plans.words import _ROLE, _role_chi2
from tallyloom.sources.scratch import written

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CLASSES, _CUTS = ["s0", "s1", "s2", "s3", "s4"], [1, 2, 3, 4]
_LABEL = "CASE WHEN list_max(scores) > {t} THEN 's' || (list_position(scores, list_max(scores)) - 1) END"
_LAB = f"WITH {_S}, l AS (" + " UNION ALL ".join(f"SELECT user_id, {t}.0::DOUBLE AS theta, {_LABEL.format(t=t)} AS label FROM s" for t in _CUTS) + ")"


def _labels(spark, d):
    return sweeps.labels_by_threshold(_scores(spark, d), F.col("scores"), _CLASSES, _CUTS, "user_id")


@query(f"{_LAB} SELECT user_id, theta, label FROM l")
def theta_labels(spark, d):
    return _labels(spark, d)


@query(f"{_LAB} SELECT theta, count(*) AS n, count(label) AS n_labelled, count(DISTINCT label) AS n_classes, round(CAST(count(label) AS DOUBLE) / count(*), 6) AS coverage FROM l GROUP BY theta")
def theta_sensitivity(spark, d):
    return b.rounded(sweeps.threshold_report(_labels(spark, d)), "coverage")


_AGREE = f"""{_LAB}, r AS (SELECT user_id, coalesce(label, '-') AS ref FROM l WHERE theta = 2), j AS (SELECT theta, coalesce(label, '-') AS label, ref FROM l JOIN r USING (user_id)),
x AS (SELECT theta, label AS v, count(*) AS na FROM j GROUP BY ALL), y AS (SELECT theta, ref AS v, count(*) AS nb FROM j GROUP BY ALL), c AS (SELECT theta, sum(CAST(na AS DOUBLE) * nb) AS s FROM x JOIN y USING (theta, v) GROUP BY theta),
t AS (SELECT theta, count(*) AS n, count(*) FILTER (WHERE label = ref) AS same FROM j GROUP BY theta)"""


@query(f"{_AGREE} SELECT theta, n, same, round(coalesce((CAST(same AS DOUBLE) / n - s / (CAST(n AS DOUBLE) * n)) / nullif(1 - s / (CAST(n AS DOUBLE) * n), 0), 1), 6) AS kappa FROM t JOIN c USING (theta)")
def theta_agreement(spark, d):
    return b.rounded(sweeps.agreement_with(_labels(spark, d), "user_id", 2.0), "kappa")


@query(f"{_LAB}, w AS (SELECT theta, label, lag(label) OVER (PARTITION BY user_id ORDER BY theta) AS before FROM l) SELECT theta, count(*) FILTER (WHERE label IS DISTINCT FROM before) AS n_changed FROM w WHERE theta > 1 GROUP BY theta")
def theta_adjacent_changes(spark, d):
    return sweeps.adjacent_changes(_labels(spark, d), "user_id")


@query(f"""{_AGREE}, k AS (SELECT theta, coalesce((CAST(same AS DOUBLE) / n - s / (CAST(n AS DOUBLE) * n)) / nullif(1 - s / (CAST(n AS DOUBLE) * n), 0), 1) AS kappa FROM t JOIN c USING (theta)),
v AS (SELECT theta, CAST(count(label) AS DOUBLE) / count(*) AS coverage FROM l GROUP BY theta) SELECT theta, round(coverage * 0.6 + kappa * 0.4, 4) AS score FROM k JOIN v USING (theta)""")
def theta_recommendation(spark, d):
    labels = _labels(spark, d)
    report = sweeps.threshold_report(labels).join(sweeps.agreement_with(labels, "user_id", 2.0).select("theta", "kappa"), "theta")
    return sweeps.recommend(report, {"coverage": 0.6, "kappa": 0.4})


_GRID = [(lam, tau) for lam in (0.1, 0.2) for tau in (0.0, 0.1)]
_BOOST = "[CASE WHEN list_contains(p, 'toxic') THEN 1.0 ELSE 0.0 END, CASE WHEN list_contains(p, 'foreign') THEN 1.0 ELSE 0.0 END, CASE WHEN list_contains(p, 'long') THEN 1.0 ELSE 0.0 END, CASE WHEN list_contains(p, 'good') THEN 1.0 ELSE 0.0 END]"
_ON = lambda i, lam, tau: f"CAST(0.45 + {lam} * bo[{i + 1}] AS DOUBLE) > {0.5 + tau}"


def _cell_sql(lam, tau):
    f1 = lambda i, c: f"coalesce(CAST(2 * count(*) FILTER (WHERE list_contains(y, '{c}') AND {_ON(i, lam, tau)}) AS DOUBLE) / nullif(2 * count(*) FILTER (WHERE list_contains(y, '{c}') AND {_ON(i, lam, tau)}) + count(*) FILTER (WHERE NOT list_contains(y, '{c}') AND {_ON(i, lam, tau)}) + count(*) FILTER (WHERE list_contains(y, '{c}') AND NOT ({_ON(i, lam, tau)})), 0), 0)"
    keep = " ".join(f"WHEN mt = '{c}' THEN {_ON(i, lam, tau)}" for i, c in enumerate(b.LABELS))
    return f"SELECT {lam}::DOUBLE AS lam, {tau}::DOUBLE AS tau, round(({' + '.join(f1(i, c) for i, c in enumerate(b.LABELS))}) / 4, 6) AS macro_f1, round(CAST(avg(CASE WHEN CASE {keep} ELSE false END THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS main_preserved FROM g"


_GRID_SQL = f"WITH {b.LABELLED_SQL}, g AS (SELECT y, {_BOOST} AS bo, {_MAIN.format('y')} AS mt FROM m)"


def _grid(spark, d):
    m = b.labelled(spark, d)
    boosts = F.array(*(F.when(F.array_contains("p", c), 1.0).otherwise(0.0) for c in b.LABELS))
    return sweeps.rerank_grid(m, F.col("y"), F.array(*(F.lit(0.45) for _ in b.LABELS)), boosts, b.LABELS, [0.1, 0.2], [0.0, 0.1], _main(F.col("y")))


@query(f"{_GRID_SQL} {' UNION ALL '.join(_cell_sql(*c) for c in _GRID)}")
def rerank_grid(spark, d):
    return b.rounded(_grid(spark, d), "macro_f1", "main_preserved")


@query(f"{_GRID_SQL}, z AS ({' UNION ALL '.join(_cell_sql(*c) for c in _GRID)}) SELECT * FROM z ORDER BY main_preserved >= 0.8 DESC, macro_f1 DESC, lam, tau LIMIT 1")
def rerank_best(spark, d):
    return b.rounded(sweeps.best_cell(_grid(spark, d)), "macro_f1", "main_preserved")


_VAR = [(0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5), (1.0, 1.0)]
_ARR = lambda b1, b2: "[" + ", ".join(f"round(greatest(0.25 + {b1} * e{i} + {b2} * g{i}, 0), 12)" for i in range(4)) + "]"


@query(f"""{_BR}, n AS (SELECT doc_id, {", ".join(f"coalesce(g{i} / nullif(g0 + g1 + g2 + g3, 0), 0) AS g{i}" for i in range(4))} FROM g), x AS (SELECT d.grp, e.*, n.* EXCLUDE (doc_id) FROM e JOIN n USING (doc_id) JOIN d USING (doc_id)),
va AS ({" UNION ALL ".join(f"SELECT '{b1}/{b2}' AS variant, grp, {_ARR(b1, b2)} AS a FROM x" for b1, b2 in _VAR)}),
p AS (SELECT variant, grp, CASE WHEN list_sum(a) > 0 THEN list_transform(a, lambda v: round(v / list_sum(a), 9)) ELSE [0.25, 0.25, 0.25, 0.25] END AS a FROM va)
SELECT variant, round(CAST(avg(CASE WHEN 'k' || (list_position(a, list_max(a)) - 1) = grp THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS accuracy FROM p GROUP BY variant""")
def correction_grid(spark, d):
    docs, wide = b.docs_k4(spark, d), written(b.counts_k4(spark, d))
    e = oversight.evidence_log_odds(docs, F.col("toks"), assoc.log_odds(wide, b.K4), b.K4)
    g = oversight.evidence_bridge(docs, F.col("toks"), wide, bridge.prob_bridge(wide, b.K4, BRIDGE_CONFIGS["B0"]), 4)
    x = docs.select("doc_id", "grp").join(e, "doc_id").join(g, "doc_id")
    prior = F.array(*(F.lit(0.25) for _ in range(4)))
    return b.rounded(sweeps.accuracy_grid(x, F.col("grp"), b.K4, {f"{b1}/{b2}": oversight.correct_additive(prior, F.col("e"), F.col("g"), b1, b2) for b1, b2 in _VAR}), "accuracy")


@query(f"""WITH {b.LABELLED_SQL}, q AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM m),
x AS (SELECT greatest(1, len(list_filter(edges, lambda v: v < n_chars))) AS bin, len(y) AS k FROM m, q)
SELECT bin, count(*) AS n, round(avg(k), 6) AS mean_labels, round(CAST(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS share_multi FROM x GROUP BY bin""")
def length_quartiles(spark, d):
    return b.rounded(sweeps.quartile_report(b.labelled(spark, d).select("n_chars", "y"), "n_chars", F.col("y")), "mean_labels", "share_multi")


@query("""WITH x AS (SELECT l.doc_id IS NOT NULL AS inc, coalesce(l.toxic = 1, false) AS hit FROM documents d LEFT JOIN labels l USING (doc_id)), t AS (SELECT count(*) AS a, count(*) FILTER (WHERE inc) AS n, count(*) FILTER (WHERE inc AND hit) AS h FROM x)
SELECT a AS n_all, n, round(CAST(h AS DOUBLE) / n, 6) AS observed, round(CAST(h AS DOUBLE) / a, 6) AS low, round(CAST(h + a - n AS DOUBLE) / a, 6) AS high FROM t""")
def exclusion_bounds(spark, d):
    x = b.table(spark, d, "documents").select("doc_id").join(b.table(spark, d, "labels"), "doc_id", "left")
    return b.rounded(sweeps.exclusion_bounds(x, F.col("toxic").isNotNull(), F.col("toxic") == 1), "observed", "low", "high")


@query("""SELECT CASE WHEN c_acctbal > 5000 THEN 'CLEAR' WHEN c_acctbal > 0 THEN 'BORDERLINE' ELSE 'ZERO' END AS tier, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS n_positive, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd,
round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q75 FROM customer GROUP BY 1""")
def tier_stats(spark, d):
    tier = F.when(F.col("c_acctbal") > 5000, "CLEAR").when(F.col("c_acctbal") > 0, "BORDERLINE").otherwise("ZERO")
    return b.rounded(sweeps.tier_stats(b.table(spark, d, "customer"), tier, "c_acctbal"), "mean", "sd", "q25", "median", "q75", places=4)


@query("""WITH e AS (SELECT event_type, user_id % 3 AS grp, value FROM events), t AS (SELECT event_type AS item, coalesce(avg(value) FILTER (WHERE grp = 0), 0) AS m0, coalesce(avg(value) FILTER (WHERE grp = 1), 0) AS m1, coalesce(avg(value) FILTER (WHERE grp = 2), 0) AS m2 FROM e GROUP BY 1)
SELECT item, round(m0, 5) AS m0, round(m1, 5) AS m1, round(m2, 5) AS m2, round((m0 + m1 + m2) / 3, 5) AS overall FROM t""")
def radar_means(spark, d):
    e = b.table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("grp"), "value")
    return b.rounded(sweeps.mean_table(e, F.col("event_type"), "grp", "value", [0, 1, 2]), "m0", "m1", "m2", "overall", places=5)


@query(f"""WITH {_ROLE}, {b.chi2_sql(3)}, p AS (SELECT exp(-chi2 / 2) AS p FROM x), k AS (SELECT p, count(*) AS k FROM p GROUP BY p), r AS (SELECT p, k, sum(k) OVER (ORDER BY p) AS rk, sum(k) OVER () AS m FROM k),
q AS (SELECT p, k, least(1.0, min(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
""" + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, CAST(coalesce(sum(k) FILTER (WHERE p < {a}), 0) AS BIGINT) AS n_raw, CAST(coalesce(sum(k) FILTER (WHERE q < {a}), 0) AS BIGINT) AS n_fdr, CAST(coalesce(sum(k) FILTER (WHERE p < {a}), 0) - coalesce(sum(k) FILTER (WHERE q < {a}), 0) AS BIGINT) AS n_dropped FROM q" for a in (0.05, 0.01, 0.001)))
def fdr_report(spark, d):
    return sweeps.fdr_report(assoc.bh_fdr(_role_chi2(spark, d)), "p_value", "p_fdr_bh", [0.05, 0.01, 0.001])


@query(f"""WITH {b.counts_sql(b.DOCS_SQL, "doc_id", b.K4, 5)}, {b.top2_sql(b.K4)}, br AS (SELECT word, "primary", secondary FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["B0"])}), k AS (SELECT grp, count(*) AS k FROM d GROUP BY grp)
SELECT w.word, count(*) AS trials, count(*) FILTER (WHERE w.grp IN (br."primary", br.secondary)) AS hits,
round(CAST(count(*) FILTER (WHERE w.grp IN (br."primary", br.secondary)) AS DOUBLE) / count(*) / (CAST(any_value(a.k + s.k) AS DOUBLE) / (SELECT count(*) FROM d)), 6) AS lift
FROM w JOIN br USING (word) JOIN k a ON a.grp = br."primary" JOIN k s ON s.grp = br.secondary GROUP BY w.word""")
def trial_hit(spark, d):
    return b.rounded(sweeps.word_trials(b.docs_k4(spark, d), F.col("toks"), "grp", _bridges(spark, d)), "lift")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark, d):
    return b.table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {b.LABELLED_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE len(y) >= 1) AS n_some, count(*) FILTER (WHERE len(y) = 0) AS n_none, count(*) FILTER (WHERE len(y) >= 2) AS n_several, CAST(sum(len(y)) AS BIGINT) AS n_labels FROM m""")
def label_count_bundle(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    k = F.size("y")
    return b.labelled(spark, d).agg(F.count(F.lit(1)).alias("n"), n(k >= 1).alias("n_some"), n(k == 0).alias("n_none"), n(k >= 2).alias("n_several"), F.sum(k).alias("n_labels"))


@query(f"""WITH {b.counts_sql(b.DOCS_SQL, "doc_id", b.K4, 5)}, {b.top2_sql(b.K4)}, br AS (SELECT word FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["loose"])}), h AS (SELECT d.doc_id, d.grp, count(br.word) AS k FROM d LEFT JOIN w USING (doc_id) LEFT JOIN br ON br.word = w.word GROUP BY ALL)
SELECT grp, count(*) AS n, count(*) FILTER (WHERE k > 0) AS n_with, round(avg(k), 6) AS mean_words FROM h GROUP BY grp""")
def bridge_presence(spark, d):
    docs = b.docs_k4(spark, d)
    wide = counts.doc_counts(docs, F.col("toks"), "grp", b.K4, 5)
    g = oversight.evidence_bridge(docs, F.col("toks"), wide, bridge.prob_bridge(wide, b.K4, BRIDGE_CONFIGS["loose"]), 4).join(docs.select("doc_id", "grp"), "doc_id")
    t = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n_bridge") > 0, 1).otherwise(0)).alias("n_with"), F.avg("n_bridge").alias("mean_words"))
    return b.rounded(t, "mean_words")
