"""Queries on texts, counts, associations and bridge words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.constants import BRIDGE_CONFIGS, DELTA_GRID
from tallyloom.functions import text as tx
from tallyloom.operators import assoc, bridge, counts, windows
from tallyloom.plans import base as b
from tallyloom.sources.scratch import written

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", tx.clean(F.col("text"), tx.ASCII).alias("cleaned"))


@query(f"WITH {b.DOCS_SQL} SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct, array_to_string(toks, ' ') AS joined FROM d")
def tokenize_ws(spark, d):
    return b.docs_k4(spark, d).select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"), F.array_join("toks", " ").alias("joined"))


@query(f"WITH {b.DOCS_SQL} SELECT doc_id, array_to_string(list_filter(toks, lambda t: t NOT IN ('the', 'of', 'and', 'de', 'la')), ' ') AS kept FROM d")
def stopword_filter(spark, d):
    toks = tx.tokens(tx.clean(F.col("text"), tx.ASCII), ["the", "of", "and", "de", "la"])
    return b.table(spark, d, "documents").select("doc_id", F.array_join(toks, " ").alias("kept"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(regexp_split_to_array(text, '[.?!。]\s*'), lambda s: string_split(s, '  '))), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS parts FROM documents)
SELECT doc_id, len(parts) AS n_sentences, array_to_string(parts, '|') AS joined FROM s""")
def sentence_split(spark, d):
    s = b.table(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("parts"))
    return s.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), F.array_join("parts", "|").alias("joined"))


@query("""
WITH x AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM conversations),
q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, block ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM x)
SELECT conv_id, turn, coalesce(asked, '(none)') AS question, text AS answer FROM q WHERE role = 'assistant'""")
def qa_pairs(spark, d):
    t = b.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return tx.qa_pairs(t, ["conv_id"], "turn", "role", "text", "user", "assistant", "(none)").select("conv_id", "turn", "question", "answer")


@query("SELECT conv_id, turn, trim(text) AS said FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def speech_filter(spark, d):
    t = b.table(spark, d, "conversations")
    return t.where((F.col("role") == "user") & (F.trim("text") != "")).select("conv_id", "turn", F.trim("text").alias("said"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_scan(spark, d):
    return b.table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(f"WITH {b.DOCS_SQL} SELECT DISTINCT doc_id, grp, unnest(toks) AS word FROM d")
def doc_word(spark, d):
    return counts.doc_words(b.docs_k4(spark, d), F.col("toks"), "doc_id", "grp")


@query(f"WITH {b.counts_sql(b.DOCS_SQL, 'doc_id', b.K4, 5)} SELECT word, c0, c1, c2, c3, total FROM c")
def doc_counts_src4(spark, d):
    return b.counts_k4(spark, d)


@query(f"WITH {b.counts_sql(b.DOCS_SQL.replace(chr(39) + 'k' + chr(39) + ' || (CAST(substr(source, 4) AS INT) % 4)', 'lang'), 'doc_id', b.LANGS, 5)} "
       + " UNION ALL ".join(f"SELECT word, '{g}' AS grp, c{i} AS cnt FROM c" for i, g in enumerate(b.LANGS)))
def doc_counts_lang(spark, d):
    wide = counts.doc_counts(b.docs_k4(spark, d), F.col("toks"), "lang", b.LANGS, 5)
    return counts.long_counts(wide, b.LANGS)


@query(f"WITH {b.counts_sql(b.TURNS_SQL, 'conv_id, turn', b.ROLES, 8, False)} SELECT word, c0, c1, c2, total FROM c")
def token_counts_role(spark, d):
    return counts.token_counts(b.turns(spark, d), F.col("toks"), "role", b.ROLES, 8)


@query(f"""WITH {b.LABELLED_SQL},
w AS (SELECT DISTINCT doc_id, 'q' || quality AS main, 't' || toxic AS sub, unnest(toks) AS word FROM m),
e AS (SELECT word, main AS grp, 1.0 AS wt FROM w UNION ALL SELECT word, sub, 0.5 FROM w)
SELECT word, round(CAST(sum(wt) FILTER (WHERE grp = 'q0') AS DOUBLE), 6) AS q0, round(CAST(sum(wt) FILTER (WHERE grp = 'q1') AS DOUBLE), 6) AS q1,
       round(CAST(sum(wt) FILTER (WHERE grp = 't0') AS DOUBLE), 6) AS t0, round(CAST(sum(wt) FILTER (WHERE grp = 't1') AS DOUBLE), 6) AS t1 FROM e GROUP BY word HAVING sum(wt) >= 8""".replace("CAST(sum(wt) FILTER", "CAST(coalesce(sum(wt) FILTER").replace(") AS DOUBLE), 6)", "), 0) AS DOUBLE), 6)"))
def weighted_counts_alpha(spark, d):
    m = b.labelled(spark, d)
    main, sub = F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string"))
    wide = counts.weighted_counts(m, F.col("toks"), main, F.array(sub), 0.5, ["q0", "q1", "t0", "t1"], 8)
    return wide.select("word", *(F.round(f"c{i}", 6).alias(c) for i, c in enumerate(["q0", "q1", "t0", "t1"])))


_K4 = b.counts_sql(b.DOCS_SQL, "doc_id", b.K4, 5)


@query(f"WITH {_K4}, {b.chi2_sql(4)} SELECT word, c0, c1, c2, c3, total, round(chi2, 6) AS chi2 FROM x")
def word_chi2(spark, d):
    return b.rounded(b.chi2_k4(spark, d), "chi2")


@query(f"WITH {_K4}, {b.chi2_sql(4)} SELECT word, round(chi2, 6) AS chi2 FROM x ORDER BY x.chi2 DESC, word LIMIT 200")
def word_chi2_top200(spark, d):
    return b.rounded(assoc.top_chi2(b.chi2_k4(spark, d)).select("word", "chi2"), "chi2")


_ROLE = b.counts_sql(b.TURNS_SQL, "conv_id, turn", b.ROLES, 5)


def _role_chi2(spark, d):
    return assoc.word_chi2(counts.doc_counts(b.turns(spark, d), F.col("toks"), "role", b.ROLES, 5), 3, p_value=True)


@query(f"WITH {_ROLE}, {b.chi2_sql(3)} SELECT word, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p_value FROM x")
def chi2_pvalue_role(spark, d):
    return b.rounded(_role_chi2(spark, d).select("word", "chi2", "p_value"), "chi2", "p_value")


@query(f"""WITH {_ROLE}, {b.chi2_sql(3)}, p AS (SELECT word, exp(-chi2 / 2) AS p FROM x),
k AS (SELECT p, count(*) AS k FROM p GROUP BY p), r AS (SELECT p, sum(k) OVER (ORDER BY p) AS rk, sum(k) OVER () AS m FROM k),
q AS (SELECT p, least(1.0, min(p * m / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT word, round(p, 6) AS p_value, round(q, 6) AS p_fdr_bh FROM p JOIN q USING (p)""")
def bh_fdr_role(spark, d):
    return b.rounded(assoc.bh_fdr(_role_chi2(spark, d).select("word", "p_value")), "p_value", "p_fdr_bh")


_ODDS = f"WITH {_K4}, {b.odds_sql(b.K4)}"


@query(f"{_ODDS} SELECT word, grp, cnt, round(log_odds, 6) AS log_odds, round(se, 6) AS se, round(z, 6) AS z FROM o")
def log_odds(spark, d):
    return b.rounded(b.odds_k4(spark, d).drop("rank"), "log_odds", "se", "z")


@query(f"{_ODDS} SELECT grp, word, rn FROM (SELECT grp, word, row_number() OVER (PARTITION BY grp ORDER BY round(log_odds, 9) DESC, word) AS rn FROM o) WHERE rn <= 20")
def log_odds_top20_per_class(spark, d):
    odds = b.odds_k4(spark, d).withColumn("log_odds", F.round("log_odds", 9))
    return assoc.top_per_class(odds, 20).select("grp", "word", "rn")


@query(f"{_ODDS} SELECT word, arg_max(grp, round(log_odds, 9) - rank * 1e-12) AS grp, round(max(log_odds), 6) AS log_odds FROM o GROUP BY word")
def word_main_class(spark, d):
    return b.rounded(assoc.main_class(b.odds_k4(spark, d).withColumn("log_odds", F.round("log_odds", 9))), "log_odds")


_TOP2 = f"WITH {_K4}, {b.top2_sql(b.K4)}"


def _bridge(config: str):
    def run(spark, d):
        return b.rounded(bridge.prob_bridge(b.counts_k4(spark, d), b.K4, BRIDGE_CONFIGS[config]), "p1", "p2", "gap")

    return run


for _name in BRIDGE_CONFIGS:
    QUERIES[f"bridge_{_name.lower()}"] = _bridge(_name)
    SQL[f"bridge_{_name.lower()}"] = f'{_TOP2} SELECT word, "primary", secondary, round(p1, 6) AS p1, round(p2, 6) AS p2, round(gap, 6) AS gap FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS[_name])}'

_CHI_TOP = f"WITH {_K4}, {b.chi2_sql(4)}, z AS (SELECT * FROM x ORDER BY chi2 DESC, word LIMIT 200), {b.top2_sql(b.K4, 'z')}"


@query(f'{_CHI_TOP} SELECT word, "primary", secondary, round(p1, 6) AS p1, round(p2, 6) AS p2, round(gap, 6) AS gap FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["B0"])}')
def bridge_of_top_chi2(spark, d):
    return b.rounded(bridge.prob_bridge(assoc.top_chi2(b.chi2_k4(spark, d)), b.K4), "p1", "p2", "gap")


@query(f'{_TOP2} SELECT word, "primary", secondary, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM b WHERE p2 / p1 >= 0.6')
def bridge_ratio(spark, d):
    return b.rounded(bridge.ratio_bridge(b.counts_k4(spark, d), b.K4), "p1", "p2")


_DELTA = f"""{_ODDS}, rk AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY log_odds DESC, rank) AS rn FROM o),
e AS (SELECT f.word, f.grp AS "primary", s.grp AS secondary, f.log_odds AS l1, s.log_odds AS l2 FROM rk f JOIN rk s USING (word)
      WHERE f.rn = 1 AND s.rn = 2 AND f.log_odds > 0 AND s.log_odds > 0 AND f.log_odds >= 0.3 AND s.log_odds >= 0.3 AND f.cnt >= 5 AND s.cnt >= 5)"""


@query(f'{_DELTA} SELECT word, "primary", secondary, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM e WHERE l1 - l2 < 1.0')
def bridge_delta(spark, d):
    return b.rounded(bridge.delta_bridge(b.odds_k4(spark, d), 1.0, 0.3).drop("total"), "l1", "l2")


@query(f"""{_DELTA} SELECT CAST(delta AS DOUBLE) AS delta, count(*) FILTER (WHERE l1 - l2 < delta) AS n_bridge,
round(CAST(count(*) FILTER (WHERE l1 - l2 < delta AND l1 - l2 < 1.0) AS DOUBLE) / nullif(count(*) FILTER (WHERE l1 - l2 < delta OR l1 - l2 < 1.0), 0), 6) AS jaccard
FROM e, (SELECT unnest([{", ".join(map(str, DELTA_GRID))}]) AS delta) WHERE l1 - l2 < 1.5 GROUP BY delta""")
def delta_ablation(spark, d):
    return b.rounded(bridge.delta_ablation(b.odds_k4(spark, d), min_logodds=0.3), "jaccard")


_FLAGS = ", ".join(f"CAST({b.bridge_rule(c)} AS INT) AS {n}" for n, c in BRIDGE_CONFIGS.items())


@query(f"{_TOP2} SELECT word, p1, p2, B0, loose, strict, B0 + loose + strict AS n_configs FROM (SELECT word, round(p1, 6) AS p1, round(p2, 6) AS p2, {_FLAGS} FROM b)".replace("round(p1, 6) AS p1, round(p2, 6) AS p2, ", "p1, p2, ").replace("SELECT word, p1, p2, B0, loose", "SELECT word, round(p1, 6) AS p1, round(p2, 6) AS p2, B0, loose"))
def bridge_presence_matrix(spark, d):
    return b.rounded(bridge.config_flags(b.counts_k4(spark, d), b.K4), "p1", "p2")


@query(f"{_TOP2}, f AS (SELECT word, {_FLAGS} FROM b), s AS (SELECT word, B0 + loose + strict AS n_configs FROM f) SELECT word, n_configs, n_configs = 3 AS in_all, n_configs >= 2 AS in_majority FROM s WHERE n_configs > 0")
def bridge_stable_words(spark, d):
    return bridge.stable_words(bridge.config_flags(b.counts_k4(spark, d), b.K4), 3)


@query(f"""WITH {_K4}, {b.chi2_sql(4)}, {b.top2_sql(b.K4)}, f AS (SELECT chi2, {_FLAGS} FROM b JOIN x USING (word)),
e AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, chi2, {n} = 1 AS hit, B0 = 1 AS ref FROM f" for n in BRIDGE_CONFIGS)})
SELECT config, count(*) FILTER (WHERE hit) AS n_bridge, round(CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*), 6) AS ratio,
round(CAST(count(*) FILTER (WHERE hit AND ref) AS DOUBLE) / nullif(count(*) FILTER (WHERE hit OR ref), 0), 6) AS jaccard,
round(avg(chi2) FILTER (WHERE hit), 6) AS chi2_bridge, round(avg(chi2) FILTER (WHERE NOT hit), 6) AS chi2_other FROM e GROUP BY config""")
def bridge_config_ablation(spark, d):
    return b.rounded(bridge.config_ablation(b.chi2_k4(spark, d), b.K4), "ratio", "jaccard", "chi2_bridge", "chi2_other")


@query(f"""WITH {_K4}, {b.top2_sql(b.K4)} SELECT word, round(b.p1, 6) AS p1, round(b.p2, 6) AS p2,
round(-({" + ".join(f"(c{i} / c.total) * ln(c{i} / c.total + 1e-12)" for i in range(4))}), 6) AS entropy, round(ln(1 + c.total), 6) AS log_total, round(b.p1 + b.p2, 6) AS top2_mass FROM c JOIN b USING (word)""")
def top2_entropy_stats(spark, d):
    t = assoc.top2_entropy(b.counts_k4(spark, d), b.K4).select("word", "p1", "p2", "entropy", "log_total", "top2_mass")
    return b.rounded(t, "p1", "p2", "entropy", "log_total", "top2_mass")


@query(f"WITH {_K4} " + " UNION ALL ".join(f"SELECT '{g}' AS grp, round(sum(CAST(c{i} AS DOUBLE) * c{i}) / (sum(c{i}) * CAST(sum(c{i}) AS DOUBLE)), 9) AS hhi FROM c" for i, g in enumerate(b.K4)))
def hhi(spark, d):
    return b.rounded(assoc.hhi(b.counts_k4(spark, d), b.K4), "hhi", places=9)


@query(f"WITH {_K4} " + " UNION ALL ".join(f"SELECT '{g}' AS a, '{h}' AS b, round(sum(CAST(c{i} AS DOUBLE) * c{j}) / (sqrt(sum(CAST(c{i} AS DOUBLE) * c{i})) * sqrt(sum(CAST(c{j} AS DOUBLE) * c{j}))), 6) AS cosine FROM c" for i, g in enumerate(b.K4) for j, h in enumerate(b.K4)))
def class_cosine(spark, d):
    return b.rounded(assoc.class_cosine(b.counts_k4(spark, d), b.K4), "cosine")


@query("""WITH o AS (SELECT quality, toxic, count(*) AS o FROM labels GROUP BY ALL), r AS (SELECT quality, sum(o) AS ra FROM o GROUP BY 1), c AS (SELECT toxic, sum(o) AS cb FROM o GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM c) AS c, sum(o) AS n FROM o),
x AS (SELECT s.*, ra * cb / CAST(n AS DOUBLE) AS e, abs(coalesce(o, 0) - ra * cb / CAST(n AS DOUBLE)) AS a FROM r CROSS JOIN c LEFT JOIN o USING (quality, toxic), s),
y AS (SELECT r, c, n, sum(power(CASE WHEN (r - 1) * (c - 1) = 1 THEN a - least(0.5, a) ELSE a END, 2) / e) AS chi2 FROM x GROUP BY r, c, n)
SELECT CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, (r - 1) * (c - 1) AS dof, round(sqrt(chi2 / n / nullif(least(r, c) - 1, 0)), 6) AS cramers_v FROM y""")
def contingency_chi2(spark, d):
    return b.rounded(assoc.contingency(b.table(spark, d, "labels"), "quality", "toxic"), "chi2", "cramers_v")


@query("""WITH g AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS DOUBLE) AS s, sum(CAST(n_chars AS DOUBLE) * n_chars) AS q FROM documents GROUP BY lang),
t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g)
SELECT round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f_stat, k - 1 AS df1, n - k AS df2 FROM t""")
def anova_f(spark, d):
    return b.rounded(assoc.anova(b.table(spark, d, "documents"), "lang", "n_chars"), "f_stat")


@query("""WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) / count(*) AS v FROM documents GROUP BY lang HAVING count(*) > 1)
SELECT x.lang AS a, y.lang AS b, round((x.m - y.m) / sqrt(x.v + y.v), 6) AS t_stat, round((x.v + y.v) * (x.v + y.v) / (x.v * x.v / (x.n - 1) + y.v * y.v / (y.n - 1)), 4) AS df
FROM g x JOIN g y ON x.lang < y.lang""")
def welch_t(spark, d):
    t = assoc.welch(b.table(spark, d, "documents"), "lang", "n_chars")
    return b.rounded(b.rounded(t, "t_stat"), "df", places=4)


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std FROM documents GROUP BY lang")
def group_stats(spark, d):
    return b.rounded(assoc.group_stats(b.table(spark, d, "documents"), "lang", "n_chars"), "mean", "std")


@query("""WITH c AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE quality = toxic) AS DOUBLE) / count(*) AS po,
(CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE) * count(*) FILTER (WHERE toxic = 0) + CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) * count(*) FILTER (WHERE toxic = 1)) / (CAST(count(*) AS DOUBLE) * count(*)) AS pe FROM labels)
SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM c""")
def kappa(spark, d):
    return b.rounded(assoc.kappa(b.table(spark, d, "labels"), F.col("quality"), F.col("toxic")), "po", "pe", "kappa")


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic0, count(*) FILTER (WHERE toxic = 1) AS toxic1 FROM labels GROUP BY quality")
def confusion_matrix(spark, d):
    t = b.table(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0)
    return t.select("quality", F.col("0").alias("toxic0"), F.col("1").alias("toxic1"))


@query(f"""WITH {_K4}, {b.odds_sql(b.K4)}, w2 AS (SELECT grp, unnest(toks) AS word FROM d), c2 AS (SELECT word, grp, count(*) AS cnt2 FROM w2 GROUP BY ALL),
j AS (SELECT o.grp, o.cnt AS a, c2.cnt2 AS b FROM o JOIN c2 USING (word, grp)),
r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY grp ORDER BY b) + (count(*) OVER (PARTITION BY grp, b) - 1) / 2.0 AS rb FROM j)
SELECT grp, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY grp""")
def spearman_token_vs_doc(spark, d):
    wide = counts.both_counts(b.docs_k4(spark, d), F.col("toks"), "grp", b.K4, 5)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("grp"), F.col(f"c{i}").alias("a"), F.col(f"t{i}").alias("b")) for i, c in enumerate(b.K4))))
    j = written(wide.select(each.alias("x")).select("x.*").where("b > 0"))
    return b.rounded(assoc.spearman(j, "a", "b", "grp"), "rho")


@query(f"""WITH {_K4}, e AS (SELECT list_sort(list_distinct(quantile_cont(total, [{", ".join(f"{i}.0 / 12" for i in range(13))}]))) AS edges FROM c)
SELECT word, total, greatest(1, len(list_filter(edges, lambda x: x < total))) AS bin FROM c, e""")
def freq_bins(spark, d):
    return windows.quantile_bins(b.counts_k4(spark, d).select("word", "total"), "total", 12)


@query(f"""WITH {_K4}, s AS (SELECT word, total, sum(total) OVER (ORDER BY total DESC, word) AS run, sum(total) OVER () AS al FROM (SELECT * FROM c ORDER BY total DESC, word LIMIT 100))
SELECT word, total, round(CAST(run AS DOUBLE) / CAST(al AS DOUBLE), 6) AS share FROM s""")
def cumulative_share(spark, d):
    top = b.counts_k4(spark, d).select("word", "total").orderBy(F.desc("total"), "word").limit(100)
    w = Window.orderBy(F.desc("total"), "word")
    return b.rounded(top.withColumn("share", F.sum("total").over(w) / F.sum("total").over(Window.partitionBy(F.lit(1)))), "share")


@query(f"""WITH {b.TURNS_SQL}, w AS (SELECT conv_id, turn, unnest(list_zip(toks, list_prepend(NULL, toks))) AS z FROM d)
SELECT z[2] AS prev, z[1] AS word, count(*) AS n FROM w WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""")
def bridge_bigrams(spark, d):
    return windows.neighbours(b.turns(spark, d), F.col("toks")).groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(f"""WITH {b.counts_sql(b.TURNS_SQL, "conv_id, turn", b.ROLES, 5)}, {b.top2_sql(b.ROLES)}, br AS (SELECT word FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["loose"])}),
u AS (SELECT conv_id, turn, role, unnest(toks) AS word FROM d)
SELECT conv_id, turn, role, word, count(*) AS n FROM u JOIN br USING (word) GROUP BY ALL""")
def bridge_utterances(spark, d):
    t = b.turns(spark, d)
    return counts.doc_words(t, F.col("toks"), "conv_id", "turn", "role", distinct=False).join(_role_bridges(t), "word", "left_semi").groupBy("conv_id", "turn", "role", "word").agg(F.count(F.lit(1)).alias("n"))


def _role_bridges(t):
    wide = counts.doc_counts(t, F.col("toks"), "role", b.ROLES, 5)
    return bridge.prob_bridge(wide, b.ROLES, BRIDGE_CONFIGS["loose"]).select("word")


_ROLE_BR = f"""WITH {b.counts_sql(b.TURNS_SQL, "conv_id, turn", b.ROLES, 5)}, {b.top2_sql(b.ROLES)}, br AS (SELECT word FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["loose"])})"""


@query(f"""{_ROLE_BR}, u AS (SELECT conv_id, role, unnest(toks) AS word FROM d)
SELECT word, count(*) AS n, count(DISTINCT conv_id) AS n_convs, count(*) FILTER (WHERE role = 'user') AS n_user FROM u JOIN br USING (word) GROUP BY word""")
def bridge_word_distribution(spark, d):
    t = b.turns(spark, d)
    u = counts.doc_words(t, F.col("toks"), "conv_id", "role", distinct=False).join(_role_bridges(t), "word", "left_semi")
    return u.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("n_convs"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("n_user"))


@query(f"""{_ROLE_BR}, u AS (SELECT conv_id, turn, list_distinct(toks) AS toks FROM d), x AS (SELECT conv_id, turn, toks, unnest(toks) AS word FROM u),
y AS (SELECT word, unnest(toks) AS other FROM x JOIN br USING (word)) SELECT word, other, count(*) AS n FROM y WHERE word <> other GROUP BY ALL HAVING count(*) >= 10""")
def bridge_cooccur(spark, d):
    t = written(b.turns(spark, d).select("role", F.array_distinct("toks").alias("toks"), F.monotonically_increasing_id().alias("row")))
    return windows.met_words(t, "row", "toks", _role_bridges(t), 10)
