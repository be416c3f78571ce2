"""Queries that join word tables, list first rows, compare small spaces and check runs against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.constants import BRIDGE_CONFIGS, DELTA_GRID
from tallyloom.functions.arrays import distribution, entropy
from tallyloom.operators import assoc, bridge, counts, evaluate, geometry, labelsets, spaces
from tallyloom.plans import base as b
from tallyloom.plans import cases as pc
from tallyloom.plans import sets as ps
from tallyloom.sources import records

QUERIES, SQL = {}, {}
_D = lambda x: f"CAST({x} AS DOUBLE)"
_K4 = b.counts_sql(b.DOCS_SQL, "doc_id", b.K4, 5)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_K4}, {b.chi2_sql(4)}, {b.odds_sql(b.K4)}, top AS (SELECT word, chi2 FROM x ORDER BY round(chi2, 9) DESC, word LIMIT 200)
SELECT o.word, o.grp, round(o.log_odds, 6) AS log_odds, round(top.chi2, 6) AS chi2 FROM o LEFT JOIN top USING (word)""")
def log_odds_with_chi2(spark, d):
    """Log-odds of all words, with the chi-square of those among the best 200."""
    top = b.chi2_k4(spark, d).select("word", "chi2").orderBy(F.desc(F.round("chi2", 9)), "word").limit(200)
    return b.rounded(b.odds_k4(spark, d).select("word", "grp", "log_odds").join(top, "word", "left"), "log_odds", "chi2")


@query(f"""WITH {_K4}, {b.chi2_sql(4)}, {b.top2_sql(b.K4, "x")} SELECT b.word, b."primary", b.secondary, round(gap, 6) AS gap, round(x.chi2, 6) AS chi2, x.total FROM b LEFT JOIN x USING (word) WHERE {b.bridge_rule(BRIDGE_CONFIGS["B0"])}""")
def bridge_with_chi2(spark, d):
    found = bridge.prob_bridge(b.counts_k4(spark, d), b.K4, BRIDGE_CONFIGS["B0"])
    return b.rounded(found.select("word", "primary", "secondary", "gap").join(b.chi2_k4(spark, d).select("word", "chi2", "total"), "word", "left"), "gap", "chi2")


@query("""WITH s AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1), m AS (SELECT lang, source, avg(n_chars) AS mean_chars FROM documents GROUP BY ALL)
SELECT m.lang, source, round(mean_chars, 6) AS mean_chars, docs FROM m LEFT JOIN s USING (lang)""")
def meta_with_summary(spark, d):
    """A table by variant with the variant's summary."""
    t = b.table(spark, d, "documents")
    meta = t.groupBy("lang", "source").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return meta.join(t.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "lang", "left")


@query(f"WITH {_K4}, {b.chi2_sql(4)}, s AS (SELECT word, " + ", ".join(f"c{i} / total AS q{i}" for i in range(4)) + ", chi2 FROM x) SELECT word, round(chi2, 6) AS chi2, " + ", ".join(f"round(q{i}, 6) AS q{i}" for i in range(4)) + " FROM s QUALIFY row_number() OVER (ORDER BY round(chi2, 9) DESC, word) <= 20")
def largest_contributions(spark, d):
    """The 20 words with the largest chi-square, the first on ties."""
    x = b.chi2_k4(spark, d).orderBy(F.desc(F.round("chi2", 9)), "word").limit(20)
    return x.select("word", F.round("chi2", 6).alias("chi2"), *(F.round(F.col(f"c{i}") / F.col("total"), 6).alias(f"q{i}") for i in range(4)))


@query(f"WITH {b.DOCS_SQL} SELECT doc_id, substr(text, 1, 60) AS raw, array_to_string(toks[1:8], ' ') AS tokens, CAST(len(toks) AS BIGINT) AS n FROM d WHERE len(toks) > 0 ORDER BY doc_id LIMIT 10")
def token_examples(spark, d):
    """The first ten texts by id with their tokens."""
    t = b.docs_k4(spark, d).where(F.size("toks") > 0).orderBy("doc_id").limit(10)
    return t.select("doc_id", F.substring("text", 1, 60).alias("raw"), F.array_join(F.slice("toks", 1, 8), " ").alias("tokens"), F.size("toks").cast("long").alias("n"))


@query("SELECT 'document' AS kind, doc_id AS id, text, lang, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text, NULL, role FROM conversations")
def union_all_texts(spark, d):
    """Documents and turns in one table; a column that one side lacks is null there."""
    docs = b.table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", "lang")
    turns = b.table(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    return docs.unionByName(turns, allowMissingColumns=True)


@query("SELECT DISTINCT 'https://' || regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE regexp_extract(lower(url), '^[a-z]+://([^?#]*)', 1) <> ''")
def canonical_paths(spark, d):
    """Addresses in one spelling, each once."""
    return records.canonical_paths(b.table(spark, d, "pages"), "url").select(F.concat(F.lit("https://"), "path").alias("path"))


@query("WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' AND length(trim(text)) >= 5) SELECT conv_id, turn, text FROM t")
def utterances(spark, d):
    """What users say in five characters or more."""
    return records.utterances(b.table(spark, d, "conversations").where("role = 'user'"), "text", 5).select("conv_id", "turn", "text")


@query("SELECT unnest([2, 3, 4, 5]) AS k, round(unnest([0.5, 1 / 3.0, 0.25, 0.2]), 6) AS chance, round(unnest([1.0, 2 / 3.0, 0.5, 0.4]), 6) AS two_of_k, round(unnest([1.0, log2(3), 2.0, log2(5)]), 6) AS bits")
def chance_levels(spark, d):
    """What chance gives over k classes: one label, one of two labels, and the entropy of a uniform choice."""
    k = F.col("k").cast("double")
    return b.rounded(spark.createDataFrame([(k,) for k in (2, 3, 4, 5)], "k int").select("k", (1 / k).alias("chance"), (2 / k).alias("two_of_k"), F.log2(k).alias("bits")), "chance", "two_of_k", "bits")


_ENT = f"""e AS (SELECT doc_id, {_D('list_sum(sc)')} AS s, sc FROM c WHERE list_sum(sc) > 0),
h AS (SELECT doc_id, list_sum(list_transform(sc, lambda x: CASE WHEN x > 0 THEN -(x / s) * log2(x / s) ELSE 0 END)) AS h FROM e)"""


@query(f"""WITH {pc.RECORDS_SQL}, {_ENT}, r AS (SELECT round(h, 9) AS a, round(h * ln(2), 9) AS z FROM h), ra AS (SELECT a, z, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS y FROM r)
SELECT count(*) AS n, round(corr(x, y), 6) AS rho, corr(x, y) > 0.999 AND count(*) >= 10 AS consistent FROM ra""")
def entropy_consistency(spark, d):
    """Rank agreement of two computations of the score entropy: in bits and in nats; consistent above 0.999 on ten cases or more."""
    t = pc.case_table(spark, d).where(F.array_max("scores") > 0)
    p = distribution(F.col("scores"))
    two = t.select(F.round(entropy(p), 9).alias("bits"), F.round(entropy(p, 2.718281828459045), 9).alias("nats"))
    return assoc.spearman(two, "bits", "nats").select("n", F.round("rho", 6).alias("rho"), ((F.col("rho") > 0.999) & (F.col("n") >= 10)).alias("consistent"))


def _points(spark, d):
    top = assoc.top_chi2(b.chi2_k4(spark, d))
    words, m = geometry.matrix(top, b.K4)
    ca = geometry.correspondence(m)
    share = m / m.sum(0)
    return words, m, ca, share


@query()
def word_structure(spark, d):
    """Words of the first class against the others in the space of class shares: rank test, effect size, centroid permutation."""
    _, _, _, share = _points(spark, d)
    first = share.argmax(0) == 0
    r = spaces.two_groups(share.T, first)
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} double" for k in r))


@query()
def space_correlation(spark, d):
    """Word coordinates from document counts against those from token counts."""
    top = assoc.top_chi2(b.chi2_k4(spark, d))
    tok = counts.token_counts(b.docs_k4(spark, d), F.col("toks"), "grp", b.K4, 5).join(top.select("word"), "word", "left_semi")
    share = lambda t: t.select("word", *((F.col(f"c{i}") / sum((F.col(f"c{j}") for j in range(1, 4)), F.col("c0"))).alias(f"q{i}") for i in range(4)))
    return spaces.two_spaces(spark, share(top), share(tok), "word", [f"q{i}" for i in range(4)], [f"q{i}" for i in range(4)])


SQL["space_correlation"] = f"""WITH {_K4}, {b.chi2_sql(4)}, top AS (SELECT * FROM x ORDER BY round(chi2, 9) DESC, word LIMIT 200),
tw AS (SELECT grp, unnest(toks) AS word FROM d), tc AS (SELECT word, {", ".join(f"count(*) FILTER (WHERE grp = '{g}') AS k{i}" for i, g in enumerate(b.K4))}, count(*) AS kt FROM tw GROUP BY 1 HAVING count(*) >= 5),
j AS (SELECT word, {", ".join(f"c{i} / total AS a{i}, {_D(f'k{i}')} / kt AS b{i}" for i in range(4))} FROM top JOIN tc USING (word)),
l AS ({" UNION ALL ".join(f"SELECT {i} AS dim, round(a{i}, 12) AS a, round(b{i}, 12) AS z FROM j" for i in range(4))}),
r AS (SELECT *, rank() OVER (PARTITION BY dim ORDER BY a) + (count(*) OVER (PARTITION BY dim, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY dim ORDER BY z) + (count(*) OVER (PARTITION BY dim, z) - 1) / 2.0 AS y FROM l)
SELECT dim, corr(a, z) AS pearson, corr(x, y) AS spearman, count(*) AS n FROM r GROUP BY 1"""


@query(f"""WITH {_K4}, {b.chi2_sql(4)}, v AS (SELECT word, chi2 FROM x ORDER BY round(chi2, 9) DESC, word LIMIT 50), {b.counts_sql(b.DOCS_SQL.replace("d AS (SELECT doc_id", "d2 AS (SELECT doc_id").replace("length(t) > 1", "length(t) > 3"), "doc_id", b.K4, 5).replace("w AS (SELECT DISTINCT", "w2 AS (SELECT DISTINCT").replace("FROM d)", "FROM d2)").replace("c AS (SELECT word", "c2 AS (SELECT word").replace("FROM w WHERE", "FROM w2 WHERE").replace("t AS (SELECT CAST", "t2 AS (SELECT CAST").replace("FROM c)", "FROM c2)")},
x2 AS (SELECT word, {" + ".join(f"coalesce((c{i} - total * n{i} / n) * (c{i} - total * n{i} / n) / nullif(total * n{i} / n, 0), 0)" for i in range(4))} AS chi2 FROM c2, t2), v2 AS (SELECT word FROM x2 ORDER BY round(chi2, 9) DESC, word LIMIT 50)
SELECT 'long words' AS variant, (SELECT count(*) FROM c2) AS n_words, (SELECT count(*) FROM v JOIN v2 USING (word)) AS both, round({_D("(SELECT count(*) FROM v JOIN v2 USING (word))")} / (SELECT count(*) FROM (SELECT word FROM v UNION SELECT word FROM v2)), 6) AS jaccard""")
def preprocessing_sensitivity(spark, d):
    """The best 50 words under another tokeniser (words of four letters or more) against the usual ones."""
    docs = b.docs_k4(spark, d)
    best = lambda wide: assoc.word_chi2(wide, 4).orderBy(F.desc(F.round("chi2", 9)), "word").limit(50).select("word")
    other = counts.doc_counts(docs.withColumn("toks", F.filter("toks", lambda t: F.length(t) > 3)), F.col("toks"), "grp", b.K4, 5)
    x, y = best(b.counts_k4(spark, d)), best(other)
    one = other.agg(F.count(F.lit(1)).alias("n_words")).join(F.broadcast(x.join(y, "word").agg(F.count(F.lit(1)).alias("both")))).join(F.broadcast(x.union(y).distinct().agg(F.count(F.lit(1)).alias("u"))))
    return one.select(F.lit("long words").alias("variant"), "n_words", "both", F.round(F.col("both") / F.col("u"), 6).alias("jaccard"))


_PAIRED = ["p5", "p7", "p11"]
_WRONG_PAIRS = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, lang AS t, {x} AS pa, {y} AS pb FROM pr WHERE {x} <> lang AND {y} <> lang" for x, y in (("p5", "p7"), ("p5", "p11"), ("p7", "p11")))
_AGREE = f"""{ps._PRED}, w AS ({_WRONG_PAIRS}), s AS (SELECT a, b, t, pa AS l, 1 AS x, 0 AS y FROM w UNION ALL SELECT a, b, t, pb, 0, 1 FROM w),
i AS (SELECT a, b, t, l, {_D("sum(x)")} AS na, {_D("sum(y)")} AS nb FROM s GROUP BY ALL), o AS (SELECT a, b, l, sum(na) AS na, sum(nb) AS nb FROM i GROUP BY ALL),
m AS (SELECT a, b, sum(na * nb) AS m, sum((na + nb) * (na + nb)) / 4 AS q FROM o GROUP BY ALL), u AS (SELECT a, b, t, sum(na * nb) / sum(na) AS c FROM i GROUP BY ALL), c AS (SELECT a, b, sum(c) AS c FROM u GROUP BY ALL),
n AS (SELECT a, b, count(*) AS n, {_D("count(*) FILTER (WHERE pa = pb)")} / count(*) AS o FROM w GROUP BY ALL),
z AS (SELECT a, b, n, o AS observed, m / ({_D("n")} * n) AS marginal, q / ({_D("n")} * n) AS pooled, c / n AS conditional, o / (c / n) AS lift, o - c / n AS excess, (o - c / n) / (1 - c / n) AS kappa FROM n JOIN m USING (a, b) JOIN c USING (a, b))"""
_RATES = ["observed", "marginal", "pooled", "conditional", "lift", "excess", "kappa"]


@query(f"WITH {_AGREE} SELECT a, b, n, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM z")
def same_wrong_report(spark, d):
    """Agreement of wrong predictions against chance, three ways."""
    return b.rounded(labelsets.same_wrong_report(ps._predictions(spark, d), "lang", _PAIRED), *_RATES)


@query(f"WITH {_AGREE} SELECT CAST(sum(n) AS BIGINT) AS n, {', '.join(f'round(sum({c} * n) / {_D("sum(n)")}, 6) AS {c}' for c in _RATES)} FROM z")
def same_wrong_means(spark, d):
    """The means of the pairs' figures, weighted by their rows."""
    return b.rounded(labelsets.weighted_means(labelsets.same_wrong_report(ps._predictions(spark, d), "lang", _PAIRED), "n", _RATES), *_RATES)


@query(f"""WITH {b.LABELLED_SQL} """ + " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, count(*) FILTER (WHERE {ps._IN('y', x)} AND {ps._IN('y', y)}) AS n, count(*) FILTER (WHERE {ps._IN('y', x)} AND {ps._IN('y', y)} AND {ps._IN('p', x)} AND {ps._IN('p', y)}) AS n_found, round({_D(f"count(*) FILTER (WHERE {ps._IN('y', x)} AND {ps._IN('y', y)} AND {ps._IN('p', x)} AND {ps._IN('p', y)})")} / nullif(count(*) FILTER (WHERE {ps._IN('y', x)} AND {ps._IN('y', y)}), 0), 6) AS rate FROM m"
    for i, x in enumerate(b.LABELS) for y in b.LABELS[i + 1 :]))
def pair_boundaries(spark, d):
    """How often both labels of a pair are found again."""
    return b.rounded(evaluate.pair_boundaries(b.labelled(spark, d), F.col("y"), F.col("p"), b.LABELS), "rate")


_F1 = " UNION ALL ".join(f"SELECT count(*) FILTER (WHERE lang = '{c}' AND p5 = '{c}') AS tp, count(*) FILTER (WHERE lang <> '{c}' AND p5 = '{c}') AS fp, count(*) FILTER (WHERE lang = '{c}' AND p5 <> '{c}') AS fn FROM pr" for c in b.LANGS)


@query(f"""WITH {ps._PRED}, k AS ({_F1}), f AS (SELECT *, coalesce({_D("2 * tp")} / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k),
g AS (SELECT {_D("2 * sum(tp)")} / {_D("2 * sum(tp) + sum(fp) + sum(fn)")} AS mi, avg(f1) AS ma, sum(f1 * (tp + fn)) / {_D("sum(tp + fn)")} AS we FROM f),
a AS (SELECT count(*) AS n, {_D("count(*) FILTER (WHERE lang = p5)")} / count(*) AS o FROM pr), e AS (SELECT sum({_D("x.k")} * y.k) AS s FROM (SELECT lang AS l, count(*) AS k FROM pr GROUP BY 1) x JOIN (SELECT p5 AS l, count(*) AS k FROM pr GROUP BY 1) y USING (l))
SELECT n, round(o, 6) AS accuracy, round((o - s / ({_D("n")} * n)) / (1 - s / ({_D("n")} * n)), 6) AS kappa, round(mi, 6) AS micro_f1, round(ma, 6) AS macro_f1, round(we, 6) AS weighted_f1 FROM g, a, e""")
def class_report(spark, d):
    """Accuracy, kappa and F1 of single labels."""
    return b.rounded(evaluate.class_report(ps._predictions(spark, d), "lang", "p5", b.LANGS), "accuracy", "kappa", "micro_f1", "macro_f1", "weighted_f1")


_FLAG = ", ".join(f"CAST({b.bridge_rule(c)} AS INT) AS {n}" for n, c in BRIDGE_CONFIGS.items())
#: Chi-square values of p = 0.05 and 0.01 at three degrees of freedom (fixed values).
_X05, _X01 = 7.814727903251179, 11.344866730144373


@query(f"""WITH {_K4}, {b.chi2_sql(4)}, {b.top2_sql(b.K4)}, f AS (SELECT chi2, {_FLAG} FROM b JOIN x USING (word)),
e AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, CASE WHEN {n} = 1 THEN chi2 END AS u, CASE WHEN {n} = 0 THEN chi2 END AS o FROM f" for n in BRIDGE_CONFIGS)}),
g AS (SELECT config, median(u) AS mu, median(o) AS mo, count(*) FILTER (WHERE u > {_X05}) AS s5, count(*) FILTER (WHERE u > {_X01}) AS s1, count(u) AS n1, count(o) AS n2, avg(u) AS m1, avg(o) AS m2, var_samp(u) / count(u) AS v1, var_samp(o) / count(o) AS v2 FROM e GROUP BY 1)
SELECT config, round(mu, 6) AS median_bridge, round(mo, 6) AS median_other, s5 AS n_sig_05, s1 AS n_sig_01, round({_D("s5")} / nullif(n1, 0), 6) AS share_sig_05, round({_D("s1")} / nullif(n1, 0), 6) AS share_sig_01,
CASE WHEN n1 >= 2 AND n2 >= 2 THEN round((m1 - m2) / sqrt(v1 + v2), 6) END AS t_stat, CASE WHEN n1 >= 2 AND n2 >= 2 THEN round((v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)), 4) END AS df FROM g""")
def bridge_config_tests(spark, d):
    """Chi-square of bridges against other words, by configuration; the operator gives the test's p-value as well."""
    stats = assoc.word_chi2(b.counts_k4(spark, d), 4, p_value=True)
    t = bridge.config_tests(stats, b.K4).drop("p_value")
    return b.rounded(t, "median_bridge", "median_other", "share_sig_05", "share_sig_01", "t_stat").withColumn("df", F.round("df", 4))


@query(f"""WITH {_K4}, {b.top2_sql(b.K4)}, f AS (SELECT least("primary", secondary) AS a, greatest("primary", secondary) AS z, {_FLAG} FROM b)
""" + " UNION ALL ".join(f"SELECT '{n}' AS config, a, z AS b, count(*) AS n FROM f WHERE {n} = 1 GROUP BY a, z" for n in BRIDGE_CONFIGS))
def bridge_config_pairs(spark, d):
    return bridge.config_pairs(b.counts_k4(spark, d), b.K4)


_NEAR = f"""{_K4}, {b.odds_sql(b.K4)}, rk AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY log_odds DESC, rank) AS rn, sum(cnt) OVER (PARTITION BY word) AS tot FROM o),
e AS (SELECT f.word, f.tot, least(f.grp, s.grp) AS a, greatest(f.grp, s.grp) AS z, f.log_odds - s.log_odds AS d FROM rk f JOIN rk s USING (word)
      WHERE f.rn = 1 AND s.rn = 2 AND f.log_odds > 0 AND s.log_odds > 0 AND f.log_odds >= 0.3 AND s.log_odds >= 0.3 AND f.cnt >= 5 AND s.cnt >= 5 AND f.tot >= 20 AND f.z >= 1 AND s.z >= 1),
k AS (SELECT CAST(unnest([{", ".join(map(str, DELTA_GRID))}]) AS DOUBLE) AS delta)"""
_RULE = {"min_logodds": 0.3, "min_total": 20, "z_min": 1.0}


@query(f"""WITH {_NEAR}, ed AS (SELECT delta, word, row_number() OVER (PARTITION BY delta ORDER BY tot DESC, word) AS rn FROM e, k WHERE d < delta),
tp AS (SELECT delta, list(word) AS ws FROM ed WHERE rn <= 50 GROUP BY 1), rf AS (SELECT list(word) AS r FROM (SELECT word, row_number() OVER (ORDER BY tot DESC, word) AS rn FROM e WHERE d < 1.0) WHERE rn <= 50)
SELECT delta, (SELECT count(*) FROM e WHERE d < delta) AS n_bridge, round({_D("(SELECT count(*) FROM e WHERE d < delta)")} / (SELECT count(*) FROM c), 6) AS ratio,
round({_D("(SELECT count(*) FROM e WHERE d < delta AND d < 1.0)")} / nullif((SELECT count(*) FROM e WHERE d < delta OR d < 1.0), 0), 6) AS jaccard,
round({_D("len(list_intersect(coalesce(ws, []), coalesce(r, [])))")} / nullif(len(list_distinct(list_concat(coalesce(ws, []), coalesce(r, [])))), 0), 6) AS jaccard_top FROM k LEFT JOIN tp USING (delta), rf""")
def delta_summary(spark, d):
    """Bridges by distance of log-odds: how many, and how alike with those of distance 1, all and the 50 most frequent."""
    return b.rounded(bridge.delta_summary(b.odds_k4(spark, d), **_RULE), "ratio", "jaccard", "jaccard_top")


@query(f"WITH {_NEAR} SELECT delta, a, z AS b, count(*) AS n FROM e, k WHERE d < delta GROUP BY ALL")
def delta_pairs(spark, d):
    return bridge.delta_pairs(b.odds_k4(spark, d), **_RULE)
