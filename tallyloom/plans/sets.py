"""Queries on labels, label sets, scores, evaluation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.constants import ABUSE_ORDER, BRIDGE_CONFIGS
from tallyloom.functions import arrays as ar
from tallyloom.functions import labels as lb
from tallyloom.operators import assoc, bridge, counts, evaluate, labelsets, windows
from tallyloom.plans import base as b

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _y():
    return F.col("y")


def _p():
    return F.col("p")


_M = f"WITH {b.LABELLED_SQL}"
_IN = lambda s, c: f"list_contains({s}, '{c}')"


@query(_M + " " + " UNION ALL ".join(
    f"SELECT '{i}' AS a, '{j}' AS b, count(*) FILTER (WHERE {_IN('y', i)} AND {_IN('y', j)}) AS n, round(CAST(count(*) FILTER (WHERE {_IN('y', i)} AND {_IN('y', j)}) AS DOUBLE) / nullif(count(*) FILTER (WHERE {_IN('y', i)}), 0), 6) AS p_b_given_a FROM m"
    for i in b.LABELS for j in b.LABELS))
def label_cooccurrence(spark, d):
    return b.rounded(labelsets.cooccurrence(b.labelled(spark, d), _y(), b.LABELS), "p_b_given_a")


@query(_M + """, s AS (SELECT lang AS main, unnest(list_distinct(y)) AS sub FROM m), t AS (SELECT lang AS main, count(*) AS docs FROM m GROUP BY 1)
SELECT main, sub, count(*) AS n, round(CAST(count(*) AS DOUBLE) / any_value(docs), 6) AS p FROM s JOIN t USING (main) WHERE main <> sub GROUP BY ALL""")
def label_transition(spark, d):
    return b.rounded(labelsets.transitions(b.labelled(spark, d), F.col("lang"), _y()), "p")


@query(_M + """, g AS (SELECT len(y) AS n_labels, count(*) AS n FROM m GROUP BY 1) SELECT n_labels, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM g""")
def poly_rate(spark, d):
    return b.rounded(labelsets.poly_rate(b.labelled(spark, d), _y()), "share")


_MAIN = "list_filter(['toxic', 'foreign', 'long', 'good'], lambda c: list_contains({}, c))[1]"


def _main(c):
    return F.get(ar.by_rank(c, b.LABELS), F.lit(0))


@query(_M + f""", e AS (SELECT {_MAIN.format('y')} AS main, unnest(list_distinct(y)) AS label FROM m)
SELECT label, count(*) AS n_docs, count(*) FILTER (WHERE label <> main) AS n_lost, round(CAST(count(*) FILTER (WHERE label <> main) AS DOUBLE) / count(*), 6) AS rate FROM e GROUP BY label""")
def info_loss(spark, d):
    return b.rounded(labelsets.information_loss(b.labelled(spark, d), _y(), _main(_y())), "rate")


@query(_M + """ SELECT lang, count(*) FILTER (WHERE len(p) > 0 AND len(y) <= 1) AS n_a, count(*) FILTER (WHERE len(p) > 0 AND len(y) > 1) AS n_b, count(*) FILTER (WHERE len(p) = 0) AS n_c FROM m GROUP BY lang""")
def label_composition(spark, d):
    return labelsets.composition(b.labelled(spark, d), _y(), _p(), "lang")


@query(_M + """ SELECT array_to_string(list_filter(['toxic', 'foreign', 'long', 'good'], lambda c: list_contains(y, c)), '|') AS combo, count(*) AS n FROM m GROUP BY 1""")
def label_combinations(spark, d):
    return labelsets.label_combinations(b.labelled(spark, d), ar.labels_to_string(_y(), b.LABELS))


_ERR = "CASE WHEN len(list_filter(y, lambda c: NOT list_contains(p, c))) = 0 AND len(list_filter(p, lambda c: NOT list_contains(y, c))) = 0 THEN 'exact' WHEN len(list_filter(p, lambda c: NOT list_contains(y, c))) = 0 THEN 'under' WHEN len(list_filter(y, lambda c: NOT list_contains(p, c))) = 0 THEN 'over' ELSE 'mixed' END"


@query(_M + f" SELECT {_ERR} AS error, count(*) AS n FROM m GROUP BY 1")
def error_type(spark, d):
    return evaluate.error_types(b.labelled(spark, d), _y(), _p())


_TP = lambda c: f"count(*) FILTER (WHERE {_IN('y', c)} AND {_IN('p', c)})"
_FP = lambda c: f"count(*) FILTER (WHERE NOT {_IN('y', c)} AND {_IN('p', c)})"
_FN = lambda c: f"count(*) FILTER (WHERE {_IN('y', c)} AND NOT {_IN('p', c)})"
_PER = "k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS label, {_TP(c)} AS tp, {_FP(c)} AS fp, {_FN(c)} AS fn FROM m" for c in b.LABELS) + """),
f AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS re, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k)"""


@query(f"{_M}, {_PER} SELECT label, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def multilabel_metrics(spark, d):
    return b.rounded(evaluate.label_metrics(b.labelled(spark, d), _y(), _p(), b.LABELS), "precision", "recall", "f1")


_WRONG = "len(list_filter(y, lambda c: NOT list_contains(p, c))) + len(list_filter(p, lambda c: NOT list_contains(y, c)))"
_JAC = "coalesce(CAST(len(list_intersect(y, p)) AS DOUBLE) / nullif(len(list_distinct(list_concat(y, p))), 0), 1)"


@query(f"""{_M}, {_PER}, g AS (SELECT CAST(2 * sum(tp) AS DOUBLE) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) AS micro_f1, avg(f1) AS macro_f1, sum(f1 * (tp + fn)) / CAST(sum(tp + fn) AS DOUBLE) AS weighted_f1 FROM f),
h AS (SELECT count(*) AS n, CAST(sum({_WRONG}) AS DOUBLE) / (count(*) * 4) AS hamming, avg(CASE WHEN {_WRONG} = 0 THEN 1.0 ELSE 0.0 END) AS subset_accuracy, avg({_JAC}) AS jaccard FROM m)
SELECT n, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(hamming, 6) AS hamming, round(CAST(subset_accuracy AS DOUBLE), 6) AS subset_accuracy, round(jaccard, 6) AS jaccard FROM g, h""")
def multilabel_overall(spark, d):
    return b.rounded(evaluate.overall_metrics(b.labelled(spark, d), _y(), _p(), b.LABELS), "micro_f1", "macro_f1", "weighted_f1", "hamming", "subset_accuracy", "jaccard")


@query(f"""{_M} SELECT count(*) AS n, round(CAST(avg(CASE WHEN len(list_intersect(y, p)) > 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS hit, round(CAST(avg(CASE WHEN {_WRONG} = 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS exact, round(avg({_JAC}), 6) AS jaccard FROM m""")
def set_compare_jaccard(spark, d):
    return b.rounded(evaluate.set_comparison(b.labelled(spark, d), _y(), _p()), "hit", "exact", "jaccard")


@query(f"""{_M}, x AS (SELECT *, list_filter(y, lambda c: c <> {_MAIN.format('y')}) AS lost FROM m)
SELECT count(*) AS n, count(*) FILTER (WHERE len(lost) > 0) AS n_lost_docs, round(avg(CAST(len(list_intersect(lost, p)) AS DOUBLE) / nullif(len(lost), 0)), 6) AS irr FROM x""")
def recovery_metrics(spark, d):
    return b.rounded(evaluate.recovery(b.labelled(spark, d), _y(), _p(), _main(_y())), "irr")


@query(f"""{_M}, x AS (SELECT *, {_MAIN.format('y')} AS mt, {_MAIN.format('p')} AS mp FROM m),
z AS (SELECT *, list_filter(y, lambda c: c <> mt) AS subs, list_filter(p, lambda c: c <> mp) AS found FROM x)
SELECT round(coalesce(CAST(sum(len(list_intersect(subs, found))) AS DOUBLE) / nullif(CAST(sum(len(subs)) AS DOUBLE), 0), 0), 6) AS companion_recall, round(CAST(avg(CASE WHEN list_contains(p, mt) THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS main_preserved FROM z""")
def companion_recall(spark, d):
    return b.rounded(evaluate.companion_boundary(b.labelled(spark, d), _y(), _p(), _main(_y()), _main(_p())), "companion_recall", "main_preserved")


@query(f"{_M} SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_WRONG} > 0) AS n_wrong, round(CAST(count(*) FILTER (WHERE {_WRONG} > 0) AS DOUBLE) / count(*), 6) AS rate FROM m GROUP BY lang")
def failure_regions(spark, d):
    return b.rounded(evaluate.failure_regions(b.labelled(spark, d), _y(), _p(), F.col("lang")), "rate")


def _predictions(spark, d):
    """Four rule predictions of a document's language class."""
    rule = lambda m: F.element_at(F.array(*map(F.lit, b.LANGS)), (F.col("n_chars") % m % 4 + 1).cast("int"))
    return b.table(spark, d, "documents").select("doc_id", "lang", *(rule(m).alias(f"p{m}") for m in (5, 7, 11)))


_PRED = "pr AS (SELECT doc_id, lang, " + ", ".join(f"['de', 'en', 'es', 'fr'][n_chars % {m} % 4 + 1] AS p{m}" for m in (5, 7, 11)) + " FROM documents)"


@query(f"""WITH {_PRED}, z AS (SELECT doc_id, list_filter([p5, p7, p11], lambda x: x <> lang) AS wrong FROM pr)
SELECT doc_id, len(wrong) AS n_wrong, len(wrong) = 3 AS all_wrong, len(list_distinct(wrong)) = 1 AS wrong_consensus, CASE WHEN len(wrong) / 3.0 > 0.7 THEN 'HIGH' WHEN len(wrong) / 3.0 > 0.4 THEN 'MODERATE' ELSE 'LOW' END AS level FROM z""")
def ambiguity_zone(spark, d):
    return evaluate.ambiguity(_predictions(spark, d), "lang", ["p5", "p7", "p11"], "doc_id")


_PAIRS = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {x} AS pa, {y} AS pb FROM pr WHERE {x} <> lang AND {y} <> lang" for x, y in (("p5", "p7"), ("p5", "p11"), ("p7", "p11")))


@query(f"""WITH {_PRED}, w AS ({_PAIRS}), sa AS (SELECT a, b, pa AS l, count(*) AS na FROM w GROUP BY ALL), sb AS (SELECT a, b, pb AS l, count(*) AS nb FROM w GROUP BY ALL),
c AS (SELECT a, b, sum(CAST(na AS DOUBLE) * nb) AS s FROM sa JOIN sb USING (a, b, l) GROUP BY ALL), t AS (SELECT a, b, count(*) AS n, CAST(count(*) FILTER (WHERE pa = pb) AS DOUBLE) / count(*) AS o FROM w GROUP BY ALL)
SELECT a, b, n, round(o, 6) AS observed, round(s / (CAST(n AS DOUBLE) * n), 6) AS expected, round(o / (s / (CAST(n AS DOUBLE) * n)), 6) AS lift FROM t JOIN c USING (a, b)""")
def same_wrong_agreement(spark, d):
    return b.rounded(labelsets.same_wrong(_predictions(spark, d), "doc_id", "lang", ["p5", "p7", "p11"]), "observed", "expected", "lift")


@query(f"""{_M}, w AS (SELECT DISTINCT doc_id, lang AS grp, unnest(toks) AS word FROM d), c AS (SELECT word, {", ".join(f"count(*) FILTER (WHERE grp = '{g}') AS c{i}" for i, g in enumerate(b.LANGS))}, count(*) AS total FROM w GROUP BY word HAVING count(*) >= 5),
{b.top2_sql(b.LANGS)}, br AS (SELECT word, least("primary", secondary) AS a, greatest("primary", secondary) AS b FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS['loose'])}),
docs AS (SELECT d.doc_id, lang, toks, grp FROM d), tries AS (SELECT doc_id, least(lang, o) AS a, greatest(lang, o) AS b FROM docs, (SELECT unnest(['de', 'en', 'es', 'fr']) AS o) WHERE lang <> o),
hit AS (SELECT DISTINCT w.doc_id, a, b FROM w JOIN br USING (word))
SELECT a, b, count(*) AS attempts, count(h.doc_id) AS hits, round(CAST(count(h.doc_id) AS DOUBLE) / count(*), 6) AS rate FROM tries LEFT JOIN (SELECT * FROM hit) h USING (doc_id, a, b) GROUP BY ALL""")
def case_hit(spark, d):
    docs = b.docs_k4(spark, d)
    wide = counts.doc_counts(docs, F.col("toks"), "lang", b.LANGS, 5)
    br = bridge.prob_bridge(wide, b.LANGS, BRIDGE_CONFIGS["loose"])
    return b.rounded(labelsets.pair_hits(docs, F.col("toks"), "lang", F.array(*map(F.lit, b.LANGS)), br), "rate")


_TYPES = ["click", "login", "logout", "purchase", "view"]


def _scores(spark, d):
    """user_id and the counts of five event types, as one array of scores."""
    e = b.table(spark, d, "events").groupBy("user_id").agg(*(F.sum(F.when(F.pmod(F.col("event_id"), F.lit(5)) == i, 1).otherwise(0)).cast("int").alias(f"s{i}") for i in range(5)))
    return e.select("user_id", F.array(*(f"s{i}" for i in range(5))).alias("scores"))


_S = "s AS (SELECT user_id, [" + ", ".join(f"CAST(count(*) FILTER (WHERE event_id % 5 = {i}) AS INT)" for i in range(5)) + "] AS scores FROM events GROUP BY user_id)"
_CUTS = [0, 1, 2, 4]
_HITS = lambda t: f"len(list_filter(scores, lambda x: x {'> 0' if t == 0 else f'>= {t}'}))"


@query(f"WITH {_S} " + " UNION ALL ".join(f"SELECT {t}.0::DOUBLE AS threshold, {m}::BIGINT AS n_domains, count(*) FILTER (WHERE {_HITS(t)} = {m}) AS n FROM s" for t in _CUTS for m in range(6)))
def domain_count_distribution(spark, d):
    return labelsets.domain_counts(_scores(spark, d), F.col("scores"), 5, _CUTS)


@query(f"WITH {_S} " + " UNION ALL ".join(f"SELECT 's{i}' AS a, 's{j}' AS b, count(*) FILTER (WHERE scores[{i + 1}] >= 4 AND " + (f"{_HITS(4)} = 1" if i == j else f"scores[{j + 1}] >= 4") + ") AS n FROM s" for i in range(5) for j in range(5)))
def pairwise_active(spark, d):
    return labelsets.pairwise_active(_scores(spark, d), F.col("scores"), [f"s{i}" for i in range(5)], 4)


@query(f"WITH {_S}, p AS (SELECT *, list_sum(scores) AS t FROM s) SELECT user_id, round(-list_sum(list_transform(scores, lambda x: CASE WHEN x > 0 THEN (x / t) * ln(x / t) ELSE 0 END)) / ln(2), 6) AS h_multi, round(list_max(scores) / t, 6) AS max_share, len(list_filter(scores, lambda x: x > 0)) AS n_active FROM p")
def entropy_raw(spark, d):
    return b.rounded(labelsets.delta_entropy(_scores(spark, d), F.col("scores"), "user_id"), "h_multi", "max_share")


@query(f"WITH {_S}, p AS (SELECT *, list_sum(scores) AS t FROM s) SELECT user_id, round((scores[1] + 0.5) / (t + 2.5), 6) AS p0, round((scores[5] + 0.5) / (t + 2.5), 6) AS p4 FROM p")
def soft_label(spark, d):
    p = ar.soft_label(F.col("scores"))
    return _scores(spark, d).select("user_id", F.round(p[0], 6).alias("p0"), F.round(p[4], 6).alias("p4"))


@query(f"""WITH {_S}, p AS (SELECT user_id, scores, list_sum(scores) AS t FROM s), q AS (SELECT user_id, list_transform(scores, lambda x: (x + 0.5) / (t + 2.5)) AS p, list_transform(scores, lambda x: CAST(x / t AS DOUBLE)) AS r FROM p),
z AS (SELECT user_id, p, r, list_zip(p, r) AS z FROM q)
SELECT user_id, round(list_sum(list_transform(z, lambda x: greatest(x[1], 1e-12) * ln(greatest(x[1], 1e-12) / greatest(x[2], 1e-12)))), 6) AS kl,
round(list_sum(list_transform(z, lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(p, lambda x: x * x))) * sqrt(list_sum(list_transform(r, lambda x: x * x)))), 6) AS cosine,
round(list_sum(list_transform(z, lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 5, 6) AS brier FROM z""")
def kl_cosine_brier(spark, d):
    p, r = ar.soft_label(F.col("scores")), ar.distribution(F.col("scores"))
    s = _scores(spark, d).select("user_id", p.alias("p"), r.alias("r"))
    return s.select("user_id", F.round(ar.kl(F.col("p"), F.col("r")), 6).alias("kl"), F.round(ar.cosine(F.col("p"), F.col("r")), 6).alias("cosine"), F.round(ar.brier(F.col("p"), F.col("r")), 6).alias("brier"))


@query("WITH t AS (SELECT d.n_chars, l.toxic FROM documents d JOIN labels l USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT {c}.0::DOUBLE AS cut, count(*) FILTER (WHERE n_chars >= {c}) AS n_pass, round(CAST(count(*) FILTER (WHERE n_chars >= {c}) AS DOUBLE) / count(*), 6) AS share, round(CAST(count(*) FILTER (WHERE n_chars >= {c} AND toxic = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE n_chars >= {c}), 0), 6) AS precision, round(CAST(count(*) FILTER (WHERE n_chars >= {c} AND toxic = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS recall FROM t"
    for c in (500, 1000, 2000, 4000)))
def threshold_sweep(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", "n_chars").join(b.table(spark, d, "labels"), "doc_id")
    return b.rounded(labelsets.threshold_sweep(t, "n_chars", [500, 1000, 2000, 4000], F.col("toxic") == 1), "share", "precision", "recall")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def label_dedupe_first(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return windows.first_by(e, ["user_id"], ["event_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti_check(spark, d):
    return b.table(spark, d, "documents").select("doc_id").join(b.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000), c AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM c) AS n_b, (SELECT count(*) FROM a JOIN c USING (doc_id)) AS both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM c)) AS either, round(CAST((SELECT count(*) FROM a JOIN c USING (doc_id)) AS DOUBLE) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM c)), 6) AS jaccard")
def presence_union(spark, d):
    a = b.table(spark, d, "documents").where("n_chars > 1000")
    return b.rounded(windows.set_overlap(a, b.table(spark, d, "labels"), "doc_id"), "jaccard")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn, sum(n) OVER (PARTITION BY user_id) AS t FROM c)
SELECT user_id, event_type AS mode, round(CAST(n AS DOUBLE) / CAST(t AS DOUBLE), 6) AS share FROM r WHERE rn = 1""")
def mode_stability(spark, d):
    return b.rounded(windows.mode_share(b.table(spark, d, "events"), "user_id", "event_type", "event_id"), "share")


@query("SELECT c_nationkey, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.75) AS q75 FROM customer GROUP BY 1".replace("quantile_cont(c_acctbal, 0.25)", "round(quantile_cont(c_acctbal, 0.25), 6)").replace("quantile_cont(c_acctbal, 0.5)", "round(quantile_cont(c_acctbal, 0.5), 6)").replace("quantile_cont(c_acctbal, 0.75)", "round(quantile_cont(c_acctbal, 0.75), 6)"))
def percentiles(spark, d):
    q = F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return b.table(spark, d, "customer").groupBy("c_nationkey").agg(q.alias("q")).select("c_nationkey", *(F.round(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((25, 50, 75))))


def _literals(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


_GT = [(1, "신체학대"), (2, "신체학대, 정서적 학대"), (3, "아동학대"), (4, "신체학대 없음"), (5, "방임 성적 학대"), (6, ""), (7, None), (8, "유기")]
_GT_OUT = [(1, "신체학대", "신체학대", "mapped"), (2, "신체학대|정서학대", "신체학대", "mapped"), (3, "", None, "unmappable"), (4, "신체학대", "신체학대", "mapped"), (5, "방임", "방임", "mapped"), (6, "", None, "missing"), (7, "", None, "missing"), (8, "방임", "방임", "mapped")]
_lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_values = lambda rows, cols: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) AS t({', '.join(cols)})"


@query(_values(_GT_OUT, ["id", "labels", "main", "status"]))
def gt_parse(spark, d):
    t = _literals(spark, _GT, "id int, txt string")
    return t.select("id", F.array_join(lb.gt_labels(F.col("txt")), "|").alias("labels"), lb.gt_main(F.col("txt")).alias("main"), lb.gt_status(F.col("txt")).alias("status"))


_SC = [(11, None, [0, 8, 5, 12], ""), (12, None, [0, 8, 0, 8], ""), (13, None, [0, 0, 5, 0], ""), (14, None, [0, 0, 5, 0], "정서학대"), (15, "성학대", [0, 8, 5, 12], "")]
_SC_OUT = [(11, "방임", "신체학대|정서학대"), (12, "신체학대", "방임"), (13, "정서학대", ""), (14, "정서학대", "정서학대"), (15, "성학대", "신체학대|정서학대|방임")]


@query(_values(_SC_OUT, ["id", "main", "subs"]))
def main_sub_labels(spark, d):
    t = _literals(spark, _SC, "id int, gt string, scores array<int>, clinical string")
    return t.withColumn("m", lb.main_sub(F.col("gt"), F.col("scores"), F.col("clinical"))).select("id", "m.main", F.array_join("m.subs", "|").alias("subs"))


_VA = [  # id, gt, crisis, total, harm, happy, worry, abuse, mood, life, urgent, peers, future
    (1, "신체학대", None, None, 0, 0, 0, 0, 0, 0, 0, 0, 0), (2, None, "정상군", None, 0, 0, 0, 0, 0, 0, 0, 0, 0), (3, None, "정상군", None, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    (4, None, None, None, 0, 7, 0, 0, 0, 0, 0, 0, 0), (5, None, "관찰필요", None, 0, 1, 0, 0, 8, 0, 0, 2, 0), (6, None, "정상군", None, 0, 1, 0, 0, 36, 0, 0, 5, 3),
    (7, None, "정상군", None, 0, 1, 0, 0, 30, 0, 0, 2, 3), (8, None, None, 8, 0, 1, 0, 0, 0, 0, 0, 0, 0), (9, None, None, 50, 0, 1, 0, 0, 0, 0, 0, 0, 0), (10, None, None, 20, 0, 1, 0, 0, 30, 0, 0, 5, 3),
]
_VA_OUT = list(zip(range(1, 11), ["부정", "긍정", "부정", "부정", "긍정", "부정", "평범", "긍정", "부정", "부정"], strict=True))


@query(_values(_VA_OUT, ["id", "valence"]))
def valence_rules(spark, d):
    names = ["gt", "crisis", "total", "harm", "happy", "worry", "abuse_q", "mood_q", "life_q", "urgent_q", "peers_q", "future"]
    t = _literals(spark, _VA, "id int, gt string, crisis string, " + ", ".join(f"{c} int" for c in names[2:]))
    return t.select("id", lb.valence(*map(F.col, names)).alias("valence"))


_RE = [(1, ["방임"], None, [], None, [0, 0, 0, 5], 0), (2, ["방임"], "방임", [], "방임", [0, 0, 0, 9], 0), (3, ["방임"], "신체학대", [], "방임", [0, 0, 0, 9], 1), (4, ["방임"], "신체학대", ["방임"], "신체학대", [0, 9, 0, 5], 0), (5, ["방임"], "신체학대", [], "신체학대", [0, 9, 0, 3], 0), (6, ["방임"], "신체학대", [], "신체학대", [0, 9, 0, 5], 0)]
_RE_OUT = [(1, "no_algorithm_main", "score"), (2, "main_match", "match"), (3, "clinical_override_from_gt", "clinical"), (4, "score_priority_gt_in_sub", "score"), (5, "gt_below_sub_threshold", "score"), (6, "gt_not_top_over_main_threshold", "score")]


@query(_values(_RE_OUT, ["id", "reason", "cause"]))
def reason_cascade(spark, d):
    t = _literals(spark, _RE, "id int, gt array<string>, main string, subs array<string>, off string, scores array<int>, n int")
    named = F.arrays_zip(F.array(*map(F.lit, ABUSE_ORDER)).alias("c"), F.col("scores").alias("s"))
    top_gt = F.coalesce(F.array_max(F.filter(named, lambda x: F.array_contains(F.col("gt"), x["c"]))["s"]), F.lit(0))
    source = lb.main_source(F.col("main"), F.col("scores"), F.array().cast("array<string>"))
    r = lb.mismatch_reason(F.col("gt"), F.col("main"), F.col("subs"), F.col("off"), source, top_gt, F.array_max("scores"), F.col("n"))
    return t.select("id", r.alias("r")).select("id", "r.reason", "r.cause")


@query(_values([(1, "CLEAR"), (2, "BORDERLINE"), (3, "ZERO")], ["id", "tier"]))
def case_tiers(spark, d):
    return _literals(spark, [(1, [0, 9, 0, 1]), (2, [0, 6, 2, 0]), (3, [0, 0, 0, 0])], "id int, scores array<int>").select("id", lb.case_tier(F.col("scores")).alias("tier"))


@query("""SELECT lang, label, round(CAST(count(*) AS DOUBLE), 6) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN (SELECT doc_id, unnest(CASE WHEN toxic = 1 THEN ['toxic', 'any'] ELSE ['any'] END) AS label FROM labels) USING (doc_id) GROUP BY ALL""")
def label_means(spark, d):
    l = b.table(spark, d, "labels").select("doc_id", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.lit("any"))).otherwise(F.array(F.lit("any")))).alias("label"))
    j = b.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(l, "doc_id")
    return j.groupBy("lang", "label").agg(F.round(F.count(F.lit(1)).cast("double"), 6).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
