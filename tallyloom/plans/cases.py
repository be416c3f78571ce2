"""Case reports over session records that are made from the documents' ids, with their SQL twins.

Every document gives one nested record (scores as texts, a question asked twice, items of other questions, bad numbers,
ground truth as text, list or object), which takes the same way as a file's: parsed, labelled, reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.constants import ABUSE_ORDER, BRIDGE_CONFIGS, NO_ABUSE
from tallyloom.functions import labels as lb
from tallyloom.operators import assoc, bridge, cases, corpora, labelsets
from tallyloom.plans import base as b
from tallyloom.sources import records
from tallyloom.sources.scratch import written

QUERIES, SQL = {}, {}
CRISES = ["응급", "정상군", "관찰필요", None, "상담필요", "정상군", None]
TRUTHS = [None, None, None, None, None, "신체학대", "신체학대, 정서적 학대", '["방임","성적 학대"]', '{"val":"아동학대"}', " "]
DIAGNOSES, OPINIONS = [None, "정서학대 의심", "", "방임", "신체학대", None], ["정서학대 소견", None, ""]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _one_of(values: list[str | None], index: str):
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(F.expr(index) == k, F.lit(v)).otherwise(out)
    return out


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """info (JSON text), list, source_file of one record a document."""
    i = b.table(spark, d, "documents").select(F.col("doc_id").alias("i"))
    audio = F.array().cast(records.AUDIO)
    item = lambda name, score: F.struct(F.lit(name), F.expr(score).cast("string"), audio)
    asked = lambda name, total, *items: F.struct(F.lit(name), F.expr(total).cast("string"), F.array(*items).cast(records.ITEMS))
    questions = F.array(
        asked("학대여부", "i % 13", item("성학대 여부", "i % 4"), item("성학대 정도", "(i div 4) % 5"), item("신체학대", "(i * 3) % 9"), item("신체학대 정도", "'x'"), item("정서학대", "(i * 7) % 10"), item("방임", "(i * 5) % 11"), item("방임 정도", "i % 3")),
        asked("기타", "1", item("정서학대", "50"), item("행복", "i % 9"), item("걱정", "(i div 2) % 3"), item("자해/자살", "if(i % 17 = 0, 1, 0)"), item("미래/진로", "i % 4")),
        asked("기분문제", "i % 37"), asked("기본생활", "i % 7"), asked("응급", "(i div 3) % 6"), asked("대인관계", "i % 6"), asked("기분문제", "if(i % 11 = 0, '없음', cast(i % 29 as string))"),
    ).cast(records.QUESTIONS)
    info = F.struct(
        F.col("i").cast("string").alias("ID"), F.when(F.expr("i % 13 = 0"), "abc").otherwise(F.expr("cast(i % 60 as string)")).alias("합계점수"), _one_of(CRISES, "i % 7").alias("위기단계"),
        _one_of(TRUTHS, "(i div 7) % 10").alias("학대의심"), _one_of(DIAGNOSES, "(i div 5) % 6").alias("임상진단"), _one_of(OPINIONS, "(i div 11) % 3").alias("임상가 종합소견"),
    )
    return i.select(F.to_json(info).alias("info"), questions.alias("list"), F.lit("made.json").alias("source_file"))


def case_table(spark: SparkSession, d: str) -> DataFrame:
    """The labelled cases of :func:`raw_records` with sources and case type."""
    rows = records.labelled(records.parse_info(raw_records(spark, d)))
    return cases.with_sources(rows.withColumn("doc_id", F.col("doc_id").cast("long")))


def with_tokens(spark: SparkSession, d: str) -> DataFrame:
    return case_table(spark, d).join(b.docs_k4(spark, d).select("doc_id", "toks"), "doc_id")


def case_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Bridge words of the four source classes, named as classes of cases."""
    found = bridge.prob_bridge(b.counts_k4(spark, d), b.K4, BRIDGE_CONFIGS["loose"])
    name = lambda c: F.element_at(F.create_map(*(x for k, v in zip(b.K4, ABUSE_ORDER, strict=True) for x in (F.lit(k), F.lit(v)))), F.col(c))
    return found.select("word", name("primary").alias("primary"), name("secondary").alias("secondary"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_case = lambda index, xs: f"CASE {index} " + " ".join(f"WHEN {k} THEN {'NULL' if x is None else chr(39) + x + chr(39)}" for k, x in enumerate(xs)) + " END"
CLS = _list(ABUSE_ORDER)
_PICK = lambda sc, cond: f"list_filter({CLS}, lambda k: {sc}[list_position({CLS}, k)] {cond})"


def label_ctes(theta: str = "6", tau: str = "4", source: str = "f", gm: str = "gm") -> str:
    """CTEs l1 to l4 from a table with sc, kw and perhaps gm: main and subs."""
    return f"""l1 AS (SELECT *, coalesce({gm}, CASE WHEN list_max(sc) > {theta} THEN {CLS}[list_position(sc, list_max(sc))] END) AS first FROM {source}),
l2 AS (SELECT *, coalesce(first, kw[1]) AS m1, list_filter({CLS}, lambda k: sc[list_position({CLS}, k)] >= {tau} AND (first IS NULL OR k <> first)) AS sub0 FROM l1),
l3 AS (SELECT *, list_filter({CLS}, lambda k: list_contains(sub0, k) OR (list_contains(kw, k) AND k <> m1)) AS sub1 FROM l2),
l4 AS (SELECT *, list_transform({CLS}, lambda k: CASE WHEN list_contains(sub1, k) THEN sc[list_position({CLS}, k)] ELSE -1 END) AS cand FROM l3),
l5 AS (SELECT * EXCLUDE (first, m1, sub0, sub1, cand), coalesce(m1, CASE WHEN len(sub1) > 0 THEN {CLS}[list_position(cand, list_max(cand))] END) AS main,
       CASE WHEN m1 IS NULL THEN list_filter(sub1, lambda k: k <> {CLS}[list_position(cand, list_max(cand))]) ELSE sub1 END AS subs FROM l4)"""


RECORDS_SQL = f"""i AS (SELECT doc_id, doc_id AS i FROM documents),
a AS (SELECT doc_id, i, [i % 4 + (i // 4) % 5, (i * 3) % 9, (i * 7) % 10, (i * 5) % 11 + i % 3] AS sc, i % 13 AS qa, CASE WHEN i % 11 = 0 THEN 0 ELSE i % 29 END AS qm, i % 7 AS ql, (i // 3) % 6 AS qu, i % 6 AS qp,
      i % 9 AS happy, (i // 2) % 3 AS worry, CASE WHEN i % 17 = 0 THEN 1 ELSE 0 END AS harm, i % 4 AS future, CASE WHEN i % 13 = 0 THEN NULL ELSE i % 60 END AS total, {_case("i % 7", CRISES)} AS crisis,
      {_case("(i // 7) % 10", TRUTHS[:7] + ["방임 성적 학대", "아동학대", " "])} AS gt_text,
      CASE (i // 7) % 10 WHEN 5 THEN ['신체학대'] WHEN 6 THEN ['신체학대', '정서학대'] WHEN 7 THEN ['방임'] ELSE CAST([] AS VARCHAR[]) END AS gt,
      concat_ws(' ', {_case("(i // 5) % 6", DIAGNOSES)}, {_case("(i // 11) % 3", OPINIONS)}) AS clinical FROM i),
f AS (SELECT *, gt[1] AS gm, list_filter({CLS}, lambda k: contains(clinical, k)) AS kw, qm + ql + qa + qu AS risk, CASE WHEN qp <= 2 THEN 1 ELSE 0 END + CASE WHEN future = 0 THEN 1 ELSE 0 END AS guard,
      CASE WHEN (i // 7) % 10 = 8 THEN 'unmappable' WHEN len(gt) > 0 THEN 'mapped' ELSE 'missing' END AS gt_status,
      CASE WHEN list_max(sc) > 6 THEN 'CLEAR' WHEN list_sum(sc) > 0 THEN 'BORDERLINE' ELSE 'ZERO' END AS tier,
      CASE WHEN crisis IN ('응급', '위기아동', '학대의심', '상담필요') THEN '부정' WHEN crisis = '정상군' THEN '긍정' WHEN crisis = '관찰필요' THEN '평범' END AS by_crisis FROM a),
{label_ctes()},
v AS (SELECT *, CASE WHEN total >= 45 THEN '부정' WHEN by_crisis IS NULL AND total <= 10 THEN '긍정' ELSE by_crisis END AS based,
      happy = 0 AND worry = 0 AND qa = 0 AND (crisis IS NULL OR crisis IN ('정상군', '관찰필요')) AS calm FROM l5),
w AS (SELECT *, CASE WHEN gm IS NOT NULL OR harm > 0 OR happy >= 7 THEN '부정' WHEN calm THEN '긍정'
      WHEN based IS NULL THEN CASE WHEN risk >= 25 AND guard = 0 THEN '부정' WHEN risk <= 10 AND guard >= 1 THEN '긍정' ELSE '평범' END
      WHEN based = '긍정' THEN CASE WHEN risk >= 35 AND guard = 0 THEN '부정' WHEN risk >= 25 THEN '평범' ELSE '긍정' END
      WHEN based = '평범' THEN CASE WHEN risk >= 25 AND guard = 0 THEN '부정' WHEN risk <= 10 AND guard >= 2 THEN '긍정' ELSE '평범' END ELSE '부정' END AS valence,
      CASE WHEN harm > 0 OR happy >= 7 THEN '부정' WHEN calm THEN '긍정' WHEN by_crisis IS NOT NULL THEN by_crisis WHEN total >= 45 THEN '부정' WHEN total <= 10 THEN '긍정' WHEN risk >= 25 THEN '부정' WHEN risk <= 10 THEN '긍정' ELSE '평범' END AS simple,
      list_transform(subs, lambda k: CASE WHEN sc[list_position({CLS}, k)] >= 4 AND list_contains(kw, k) THEN 'both' WHEN sc[list_position({CLS}, k)] >= 4 THEN 'score' WHEN list_contains(kw, k) THEN 'clinical' ELSE 'unknown' END) AS sources FROM v),
c AS (SELECT *, valence = '부정' AS in_neg, CASE WHEN gm = main AND len(subs) > 0 THEN 'A' WHEN coalesce(gm <> main, true) AND coalesce(list_contains(subs, gm), false) THEN 'B'
      WHEN list_contains(sources, 'clinical') OR list_contains(sources, 'both') THEN 'C' WHEN gm = main THEN 'D' ELSE 'E' END AS case_type FROM w)"""
_D = lambda x: f"CAST({x} AS DOUBLE)"


@query(f"WITH {RECORDS_SQL} SELECT doc_id, valence, simple, sc[1] AS s0, sc[2] AS s1, sc[3] AS s2, sc[4] AS s3, main, array_to_string(subs, '|') AS subs, array_to_string(gt, '|') AS gt, gm AS gt_main, gt_status, tier, array_to_string(kw, '|') AS named FROM c")
def case_labels(spark, d):
    t = case_table(spark, d)
    joined = lambda c, name: F.array_join(c, "|").alias(name)
    return t.select("doc_id", "valence", "simple", *(F.col("scores")[k].cast("long").alias(f"s{k}") for k in range(4)), "main", joined("subs", "subs"), joined("gt", "gt"), "gt_main", "gt_status", "tier", joined("keywords", "named"))


@query(f"WITH {RECORDS_SQL} SELECT len(subs) AS n_subs, count(*) AS n, round({_D('count(*)')} / sum(count(*)) OVER (), 6) AS share FROM c WHERE main IS NOT NULL GROUP BY 1")
def case_sub_rates(spark, d):
    return b.rounded(cases.sub_rates(case_table(spark, d)), "share")


@query(f"WITH {RECORDS_SQL}, e AS (SELECT main, sc, unnest(subs) AS sub, unnest(sources) AS source FROM c WHERE main IS NOT NULL) SELECT main, sub, source, count(*) AS n, round(avg(sc[list_position({CLS}, sub)]), 6) AS mean_score FROM e GROUP BY ALL")
def case_sub_sources(spark, d):
    return b.rounded(cases.sub_sources(case_table(spark, d)), "mean_score")


@query(f"WITH {RECORDS_SQL} SELECT case_type, count(*) AS n, round({_D('count(*)')} / sum(count(*)) OVER (), 6) AS share FROM c WHERE gm IS NOT NULL AND main IS NOT NULL GROUP BY 1")
def case_type_shares(spark, d):
    return b.rounded(cases.case_types(case_table(spark, d)), "share")


@query(f"WITH {RECORDS_SQL} SELECT case_type, doc_id, main, array_to_string(subs, '|') AS subs FROM c WHERE main IS NOT NULL AND case_type IN ('A', 'B', 'C') QUALIFY row_number() OVER (PARTITION BY case_type ORDER BY doc_id) <= 5")
def case_type_examples(spark, d):
    return cases.first_of_types(case_table(spark, d), ["A", "B", "C"])


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT gm, len(kw) >= 2 AS multi, gm IS NOT NULL AND len(list_filter(kw, lambda k: k <> gm)) > 0 AS extra FROM c WHERE main IS NOT NULL AND trim(clinical) <> '')
SELECT CAST(NULL AS VARCHAR) AS gt_main, count(*) AS n, count(*) FILTER (WHERE multi) AS n_multi, count(*) FILTER (WHERE extra) AS n_extra FROM e
UNION ALL SELECT gm, count(*), count(*) FILTER (WHERE multi), count(*) FILTER (WHERE extra) FROM e WHERE gm IS NOT NULL GROUP BY gm""")
def clinical_mentions(spark, d):
    return cases.clinical_mentions(case_table(spark, d))


@query(f"WITH {RECORDS_SQL}, e AS (SELECT gm AS gt_main, unnest(list_filter(kw, lambda k: k <> gm)) AS extra FROM c WHERE main IS NOT NULL AND gm IS NOT NULL AND trim(clinical) <> '') SELECT gt_main, extra, count(*) AS n FROM e GROUP BY ALL")
def clinical_extra(spark, d):
    return cases.extra_mentions(case_table(spark, d))


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT sc[list_position({CLS}, gm)] AS own, len(list_filter({CLS}, lambda k: k <> gm AND sc[list_position({CLS}, k)] >= 4)) AS others FROM c WHERE gm IS NOT NULL)
SELECT count(*) AS n, round(avg(own), 6) AS mean_own, count(*) FILTER (WHERE others >= 1) AS n_with_other, round(avg(others), 6) AS mean_other, round(100 * avg(CASE WHEN others >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pct_with_other FROM e""")
def gt_consistency(spark, d):
    return b.rounded(cases.gt_consistency(case_table(spark, d)), "mean_own", "mean_other", "pct_with_other")


_WEAK = f"""e AS (SELECT gm, main, subs, list_filter({CLS}, lambda k: k = main OR list_contains(subs, k)) AS every, gt FROM c WHERE gm IS NOT NULL AND main IS NOT NULL),
g AS (SELECT gm, main, count(*) AS k FROM e GROUP BY ALL), pe AS (SELECT sum({_D('x.k')} * y.k) AS s FROM (SELECT gm AS l, sum(k) AS k FROM g GROUP BY 1) x JOIN (SELECT main AS l, sum(k) AS k FROM g GROUP BY 1) y USING (l)),
h AS (SELECT {_D('count(*)')} AS n, {_D("count(*) FILTER (WHERE len(every) >= 2)")} AS m, {_D("sum(len(list_filter(every, lambda k: NOT list_contains(gt, k)))) FILTER (WHERE len(every) >= 2)")} AS missed, {_D("count(*) FILTER (WHERE gm <> main)")} AS w,
      {_D("count(*) FILTER (WHERE gm <> main AND gm <> '성학대' AND main <> '성학대')")} AS mild, {_D("count(*) FILTER (WHERE gm <> main AND (gm = '정서학대' OR main = '정서학대'))")} AS emo, {_D("count(*) FILTER (WHERE gm <> main AND list_contains(subs, gm))")} AS ins FROM e),
k AS (SELECT n, m, missed, w, mild, emo, ins, ((n - w) / n - s / (n * n)) / (1 - s / (n * n)) AS kappa FROM h, pe)"""


@query(f"""WITH {RECORDS_SQL}, {_WEAK} SELECT CAST(n AS BIGINT) AS n, CAST(w AS BIGINT) AS n_mismatch, round(m / n, 6) AS multi_rate, round(missed / m, 6) AS avg_missed, round(mild / nullif(w, 0), 6) AS mild_rate,
round(emo / nullif(w, 0), 6) AS emotional_rate, round(ins / nullif(w, 0), 6) AS in_sub_rate, round((n - w) / n, 6) AS accuracy, round(kappa, 6) AS kappa FROM k""")
def weakness_bundle(spark, d):
    return b.rounded(cases.weakness(case_table(spark, d)), "multi_rate", "avg_missed", "mild_rate", "emotional_rate", "in_sub_rate", "accuracy", "kappa")


_K4 = b.counts_sql(b.DOCS_SQL, "doc_id", b.K4, 5)
_NAME = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(b.K4, ABUSE_ORDER, strict=True)) + " END"
#: Cases come as ``c``; the word counts' own ``c`` is renamed.
_BRIDGE = f"""{_K4.replace("c AS (SELECT word", "wc AS (SELECT word").replace("FROM c)", "FROM wc)").replace("w AS (SELECT DISTINCT", "ww AS (SELECT DISTINCT").replace("FROM w WHERE", "FROM ww WHERE")}, {b.top2_sql(b.K4, "wc").replace("r AS (SELECT *, row", "wr AS (SELECT *, row").replace("FROM r f JOIN r s", "FROM wr f JOIN wr s")},
br AS (SELECT word, {_NAME('"primary"')} AS lead FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["loose"])}),
tk AS (SELECT DISTINCT doc_id, unnest(toks) AS word FROM d),
bp AS (SELECT c.doc_id, len(c.subs) > 0 AS has_sub, count(br.word) AS k FROM c LEFT JOIN tk USING (doc_id) LEFT JOIN br USING (word) WHERE c.main IS NOT NULL GROUP BY ALL),
bm AS (SELECT br.word, count(*) AS n, count(*) FILTER (WHERE c.main <> lead) AS n_mismatch FROM c JOIN tk USING (doc_id) JOIN br USING (word) WHERE c.main IS NOT NULL GROUP BY 1)"""


@query(f"WITH {RECORDS_SQL}, {_BRIDGE} SELECT has_sub, count(*) AS n, count(*) FILTER (WHERE k > 0) AS n_with, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(k), 6) AS mean_words FROM bp GROUP BY 1")
def bridge_by_sub(spark, d):
    t = with_tokens(spark, d)
    return b.rounded(cases.bridge_presence(t, F.col("toks"), case_bridges(spark, d)), "rate", "mean_words")


@query(f"WITH {RECORDS_SQL}, {_BRIDGE} SELECT word, n, n_mismatch, round({_D('n_mismatch')} / n, 6) AS rate FROM bm")
def bridge_mismatch(spark, d):
    return b.rounded(cases.bridge_mismatch(with_tokens(spark, d), F.col("toks"), case_bridges(spark, d)), "rate")


_PAIRNAME = f"""pb AS (SELECT word, least({_NAME('"primary"')}, {_NAME('secondary')}) AS a, greatest({_NAME('"primary"')}, {_NAME('secondary')}) AS z FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS["loose"])}),
att AS (SELECT doc_id, least(main, sub) AS a, greatest(main, sub) AS z FROM (SELECT doc_id, main, unnest(subs) AS sub FROM c WHERE main IS NOT NULL) WHERE main <> sub),
hits AS (SELECT DISTINCT doc_id, a, z FROM tk JOIN pb USING (word))"""


@query(f"WITH {RECORDS_SQL}, {_BRIDGE}, {_PAIRNAME} SELECT att.a, att.z AS b, count(*) AS attempts, count(hits.doc_id) AS hits, round({_D('count(hits.doc_id)')} / count(*), 6) AS rate FROM att LEFT JOIN hits USING (doc_id, a, z) GROUP BY ALL")
def bridge_pair_match(spark, d):
    t = with_tokens(spark, d).where("main IS NOT NULL")
    return b.rounded(labelsets.pair_hits(t, F.col("toks"), "main", F.col("subs"), case_bridges(spark, d)), "rate")


@query(f"""WITH {RECORDS_SQL}, {_BRIDGE}, {_WEAK.replace("h AS (", "wh AS (").replace("FROM h, pe", "FROM wh, pe")},
en AS (SELECT avg(CASE WHEN len(subs) > 0 THEN log2(1 + len(subs)) ELSE 0 END) AS mean_loss, count(*) FILTER (WHERE len(subs) = 0) AS n1, count(*) FILTER (WHERE len(subs) > 0) AS n2 FROM c WHERE main IS NOT NULL),
li AS (SELECT (SELECT {_D('sum(n_mismatch)')} / sum(n) FROM bm) AS mm, avg(CASE WHEN has_sub THEN CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END END) AS rs, avg(CASE WHEN NOT has_sub THEN CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END END) AS rn FROM bp),
z AS (SELECT * FROM en, li, k), p AS (SELECT *, printf('%.4f', mean_loss) AS t1, CAST(n1 AS VARCHAR) AS t2, CAST(n2 AS VARCHAR) AS t3, printf('%.1f%%', 100 * coalesce(mm, 0)) AS t4,
      printf('%.1f%%', 100 * coalesce(rs, 0)) || ' vs ' || printf('%.1f%%', 100 * coalesce(rn, 0)) AS t5, printf('%.1f%%', 100 * coalesce(mild / nullif(w, 0), 0)) AS t6, printf('%.1f%%', 100 * coalesce(ins / nullif(w, 0), 0)) AS t7, printf('%.4f', kappa) AS t8 FROM z)
SELECT unnest(['numeric', 'numeric', 'numeric', 'linguistic', 'linguistic', 'structural', 'structural', 'structural']) AS layer,
       unnest(['mean entropy loss', 'single labels', 'several labels', 'bridge mismatch', 'bridge presence with and without sub', 'mismatch outside the most severe class', 'ground truth among subs', 'kappa']) AS indicator,
       unnest([t1, t2, t3, t4, t5, t6, t7, t8]) AS value FROM p""")
def triangulation_report(spark, d):
    t, found = written(with_tokens(spark, d).withColumn("toks", F.array_distinct("toks"))), written(case_bridges(spark, d))
    some = t.where("main IS NOT NULL")
    entropy = some.agg(F.avg(F.when(F.size("subs") > 0, F.log2(1.0 + F.size("subs"))).otherwise(0.0)).alias("mean_loss"), F.sum((F.size("subs") == 0).cast("long")).alias("n_single"), F.sum((F.size("subs") > 0).cast("long")).alias("n_multi"))
    wrong = cases.bridge_mismatch(t, F.col("toks"), found).agg((F.sum("n_mismatch") / F.sum("n")).alias("mismatch_rate"))
    there = cases.bridge_presence(t, F.col("toks"), found)
    rates = there.agg(F.max(F.when(F.col("has_sub"), F.col("rate"))).alias("rate_sub"), F.max(F.when(~F.col("has_sub"), F.col("rate"))).alias("rate_none"))
    return cases.triangulation(entropy, wrong.join(F.broadcast(rates)), cases.weakness(t))


#: Published counts of the earlier corpus (fixed values).
BEFORE = {"records": 3236.0, "negative": 1970.0, "neutral": None, "abuse_negative": 1496.0, "with_gt": 1343.0}


@query(f"""WITH {RECORDS_SQL}, n AS (SELECT count(*) AS r, count(*) FILTER (WHERE in_neg) AS g, count(*) FILTER (WHERE valence = '평범') AS u, count(*) FILTER (WHERE in_neg AND main IS NOT NULL) AS a, count(*) FILTER (WHERE in_neg AND main IS NOT NULL AND len(gt) > 0) AS t FROM c),
m AS (SELECT unnest({_list(BEFORE)}) AS metric, unnest([3236.0, 1970.0, NULL, 1496.0, 1343.0]) AS old, unnest([r, g, u, a, t]) AS new FROM n)
SELECT metric, {_D('old')} AS old, {_D('new')} AS new, {_D('new')} - {_D('old')} AS difference FROM m""")
def before_after(spark, d):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    neg, abuse = F.col("in_neg"), F.col("in_abuse_neg")
    one = case_table(spark, d).agg(F.count(F.lit(1)).alias("records"), count(neg).alias("negative"), count(F.col("valence") == "평범").alias("neutral"), count(abuse).alias("abuse_negative"), count(abuse & F.col("in_gt")).alias("with_gt"))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BEFORE))).alias("x")).select("x.*")
    return cases.before_after(long, BEFORE)


@query(f"""WITH {RECORDS_SQL}, g AS (SELECT * FROM c WHERE in_neg AND gm IS NULL), l AS (SELECT unnest({_list(ABUSE_ORDER)[:-1]}, NULL]) AS m)
SELECT l.m AS main, count(g.doc_id) AS n, round({_D('count(g.doc_id)')} / (SELECT count(*) FROM g), 6) AS share, count(g.doc_id) FILTER (WHERE len(subs) > 0) AS n_sub, count(g.doc_id) FILTER (WHERE trim(clinical) = '') AS n_without_text
FROM l LEFT JOIN g ON l.m IS NOT DISTINCT FROM g.main GROUP BY 1""")
def no_gt_recovery(spark, d):
    return b.rounded(cases.no_gt_group(case_table(spark, d)), "share")


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT valence, gt_status, main, list_filter({CLS}, lambda k: k = main OR list_contains(subs, k)) AS labels FROM c),
x AS (SELECT labels, unnest(labels) AS x FROM e), y AS (SELECT x, unnest(labels) AS y FROM x)
SELECT 'all' AS section, 'records' AS key, count(*) AS n FROM e UNION ALL SELECT 'valence', valence, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'gt', gt_status, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'main', main, count(*) FROM e WHERE main IS NOT NULL GROUP BY 2 UNION ALL SELECT 'cardinality', CAST(len(labels) AS VARCHAR), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'pair', x || '|' || y, count(*) FROM y WHERE x < y GROUP BY 2""")
def dataset_report(spark, d):
    return cases.dataset_report(case_table(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT substr(trim(gt_text), 1, 80) AS value, count(*) AS n FROM c WHERE trim(gt_text) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def gt_top_values(spark, d):
    return cases.gt_values(case_table(spark, d), F.col("gt_text"))


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT gm, list_filter({CLS}, lambda k: k <> gm AND (k = main OR list_contains(subs, k))) AS o FROM c WHERE gm IS NOT NULL AND main IS NOT NULL),
g AS (SELECT gm, count(*) AS n_gt, count(*) FILTER (WHERE len(o) > 0) AS n_with_any FROM e GROUP BY 1), s AS (SELECT unnest({CLS}) AS sub),
p AS (SELECT gm AS gt_main, sub, n_gt, n_with_any, (SELECT count(*) FROM e WHERE e.gm = g.gm AND list_contains(o, sub)) AS n FROM g, s WHERE gm <> sub)
SELECT p.gt_main, p.sub, p.n_gt, p.n_with_any, p.n, round({_D('p.n')} / p.n_gt, 6) AS p, round({_D('p.n')} / p.n_gt + coalesce({_D('q.n')} / q.n_gt, 0), 6) AS density FROM p LEFT JOIN p q ON p.gt_main = q.sub AND p.sub = q.gt_main""")
def hidden_companions(spark, d):
    return b.rounded(cases.companions(case_table(spark, d)), "p", "density")


@query(f"WITH {RECORDS_SQL} SELECT main, count(*) AS n, count(*) FILTER (WHERE len(subs) > 0) AS n_poly, round(avg(CASE WHEN len(subs) > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(len(subs)), 6) AS mean_subs FROM c WHERE main IS NOT NULL GROUP BY 1")
def poly_by_main(spark, d):
    return b.rounded(cases.poly_by_main(case_table(spark, d)), "rate", "mean_subs")


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT gm, list_filter(gt, lambda k: k <> gm) AS lost FROM c WHERE gm IS NOT NULL), t AS (SELECT gm, count(*) FILTER (WHERE len(lost) > 0) AS docs FROM e GROUP BY 1),
u AS (SELECT gm, unnest(lost) AS lost FROM e) SELECT gm AS gt_main, lost, count(*) AS n, docs FROM u JOIN t USING (gm) GROUP BY ALL""")
def lost_label_pairs(spark, d):
    return cases.lost_pairs(case_table(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT gt_status, count(*) AS n, round({_D('count(*)')} / sum(count(*)) OVER (), 6) AS share, round(avg(list_max(sc)), 6) AS mean FROM c GROUP BY 1")
def gt_status_means(spark, d):
    return b.rounded(cases.status_means(case_table(spark, d).withColumn("top", F.array_max("scores")), "top"), "share", "mean")


@query(f"WITH {RECORDS_SQL} SELECT tier, crisis, count(*) AS n, round({_D('count(*)')} / sum(count(*)) OVER (PARTITION BY tier), 6) AS share FROM c GROUP BY 1, 2")
def tier_by_crisis(spark, d):
    return b.rounded(cases.tier_by_crisis(case_table(spark, d)), "share")


@query(f"WITH {RECORDS_SQL} SELECT tier, array_to_string({_PICK('sc', '>= 4')}, '|') AS pattern, count(*) AS n FROM c GROUP BY ALL")
def score_patterns(spark, d):
    return cases.score_patterns(case_table(spark, d))


_PAIRS = f"""o AS (SELECT list_transform(sc, lambda s: s >= 4) AS o FROM c), p AS (SELECT x.k AS i, y.k AS j FROM range(1, 5) x(k), range(1, 5) y(k)),
q AS (SELECT {CLS}[i] AS a, {CLS}[j] AS b, {_D("(SELECT count(*) FROM o WHERE CASE WHEN i = j THEN o[i] AND len(list_filter(o, lambda z: z)) = 1 ELSE o[i] AND o[j] END)")} AS n FROM p)"""


@query(f"WITH {RECORDS_SQL}, {_PAIRS} SELECT a, b, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY a), 0), 0), 6) AS row_share, round(coalesce(n / nullif(sum(n) OVER (), 0), 0), 6) AS all_share FROM q")
def pairwise_shares(spark, d):
    pairs = labelsets.pairwise_active(case_table(spark, d), F.col("scores"), ABUSE_ORDER, 4)
    by = lambda k: cases.pairwise_shares(pairs, k).withColumnRenamed("share", f"{k}_share")
    return b.rounded(by("row").join(by("all"), ["a", "b"]), "row_share", "all_share")


_GRID = "t AS (SELECT f.*, theta, tau FROM f, (SELECT unnest([4, 5, 6, 7, 8]) AS theta) x, (SELECT unnest([2, 3, 4, 5]) AS tau) y)"
_BEFORE_LABELS = RECORDS_SQL[: RECORDS_SQL.index("l1 AS (")].rstrip().rstrip(",")
_GRID_LABELS = f"{_BEFORE_LABELS}, {_GRID}, {label_ctes('theta', 'tau', 't', 'NULL')}"


@query(f"WITH {_GRID_LABELS} SELECT doc_id, theta, tau, main, array_to_string(subs, '|') AS subs, main IS NOT NULL AND list_max(sc) <= theta AS clinical_used FROM l5")
def threshold_labels(spark, d):
    out = cases.threshold_labels(case_table(spark, d), [4, 5, 6, 7, 8], [2, 3, 4, 5])
    return out.withColumn("subs", F.array_join("subs", "|"))


_TAU = f"""{_GRID_LABELS}, e AS (SELECT doc_id, tau, subs, list_filter({CLS}, lambda k: k = main OR list_contains(subs, k)) AS every FROM l5 WHERE theta = 6 AND main IS NOT NULL),
j AS (SELECT e.*, {_D('len(list_intersect(e.every, r.every))')} / len(list_distinct(list_concat(e.every, r.every))) AS j FROM e JOIN e r ON e.doc_id = r.doc_id AND r.tau = 4),
y AS (SELECT tau, count(*) AS n, 100 * avg(CASE WHEN len(subs) > 0 THEN 1.0 ELSE 0.0 END) AS pct_sub, avg(len(subs)) AS mean_subs, CAST(sum(len(subs)) AS BIGINT) AS n_pairs, avg(j) AS j_mean, quantile_cont(j, 0.5) AS j_median, stddev_pop(j) AS j_sd FROM j GROUP BY 1)"""


@query(f"WITH {_TAU} SELECT tau, n, round(pct_sub, 6) AS pct_sub, round(mean_subs, 6) AS mean_subs, n_pairs, round(j_mean, 6) AS j_mean, round(j_median, 6) AS j_median, round(j_sd, 6) AS j_sd FROM y")
def tau_sensitivity(spark, d):
    return b.rounded(cases.tau_sensitivity(cases.threshold_labels(case_table(spark, d), [6], [2, 3, 4, 5])), "pct_sub", "mean_subs", "j_mean", "j_median", "j_sd")


@query(f"WITH {RECORDS_SQL} SELECT array_to_string(list_filter([CASE WHEN in_neg THEN 'NEG' END, CASE WHEN in_neg AND main IS NOT NULL THEN 'ABUSE_NEG' END, CASE WHEN len(gt) > 0 THEN 'GT' END], lambda x: x IS NOT NULL), '|') AS membership, count(*) AS n FROM c GROUP BY 1")
def corpus_membership(spark, d):
    return cases.corpus_membership(case_table(spark, d))


@query(f"WITH {RECORDS_SQL} SELECT doc_id, gm AS label, array_to_string(gt, '|') AS labels FROM c WHERE in_neg AND main IS NOT NULL AND len(gt) > 0 UNION ALL SELECT doc_id, '{NO_ABUSE}', '{NO_ABUSE}' FROM c WHERE NOT in_neg")
def five_class_corpus(spark, d):
    return cases.five_class(case_table(spark, d), NO_ABUSE).withColumn("labels", F.array_join("labels", "|"))


@query(f"WITH {RECORDS_SQL} SELECT doc_id, CASE WHEN list_max(sc) > 6 THEN 'score' WHEN main IS NULL THEN 'none' WHEN sc[list_position({CLS}, main)] > 6 THEN 'score' WHEN list_contains(kw, main) THEN 'clinical' WHEN sc[list_position({CLS}, main)] >= 4 THEN 'fallback_sub' ELSE 'unknown' END AS source FROM c WHERE gm IS NULL")
def main_sources(spark, d):
    t = case_table(spark, d).where("gt_main IS NULL")
    return t.select("doc_id", lb.main_source(F.col("main"), F.col("scores"), F.col("keywords")).alias("source"))


#: The corpora of the log-odds tables: their condition, and whether cases without abuse are a fifth class.
CORPORA = {"ALL": ("true", True), "NEG": ("in_neg", False), "ABUSE_NEG": ("in_neg", False), "TRAIN": ("true", True)}
FIVE = [*ABUSE_ORDER, NO_ABUSE]


def _masked(spark, d):
    t = with_tokens(spark, d)
    label = F.when(F.col("in_neg") & F.col("main").isNotNull() & (F.size("gt") > 0), F.col("gt_main")).when(~F.col("in_neg"), F.lit(NO_ABUSE))
    return written(corpora.counts_by_membership(t.withColumn("label", label), F.col("toks"), "label", FIVE, {n: F.expr(c) for n, (c, _) in CORPORA.items()}))


def _table(by_mask, name):
    classes = FIVE if CORPORA[name][1] else ABUSE_ORDER
    return corpora.corpus_counts(by_mask, list(CORPORA), name, FIVE, classes), classes


_DOCS = f"WITH {RECORDS_SQL}, tk AS ({b.DOCS_SQL.removeprefix('d AS (').removesuffix(')')}), lab AS (SELECT c.doc_id, c.in_neg, CASE WHEN in_neg AND main IS NOT NULL AND len(gt) > 0 THEN gm WHEN NOT in_neg THEN '{NO_ABUSE}' END AS grp, toks FROM c JOIN tk USING (doc_id))"


def _corpus_sql(name: str) -> str:
    condition, five = CORPORA[name]
    return b.counts_sql(f"d AS (SELECT * FROM lab WHERE {condition})", "doc_id", FIVE if five else ABUSE_ORDER, 5)


@query(_DOCS + " " + " UNION ALL ".join(f"SELECT '{n}' AS corpus, word, grp, cnt, round(log_odds, 6) AS log_odds, round(z, 6) AS z FROM (WITH {_corpus_sql(n)}, {b.odds_sql(FIVE if five else ABUSE_ORDER)} SELECT * FROM o)" for n, (_, five) in CORPORA.items()))
def corpora_log_odds(spark, d):
    """Four log-odds tables from one count."""
    by_mask, out = _masked(spark, d), None
    for name in CORPORA:
        wide, classes = _table(by_mask, name)
        x = assoc.log_odds(wide, classes).select(F.lit(name).alias("corpus"), "word", "grp", "cnt", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z"))
        out = x if out is None else out.unionByName(x)
    return out


def _found_sql(source: str) -> str:
    """Bridge words among the 200 best words of ``c`` and ``t`` of the source's CTEs."""
    return f"(WITH {source}, {b.chi2_sql(4)}, best AS (SELECT * FROM x ORDER BY chi2 DESC, word LIMIT 200), {b.top2_sql(ABUSE_ORDER, 'best')} SELECT word FROM b WHERE {b.bridge_rule(BRIDGE_CONFIGS['B0'])})"


@query(_DOCS + f""", diagnostic AS {_found_sql(_corpus_sql("ABUSE_NEG"))},
train AS (WITH {_corpus_sql("TRAIN")} SELECT * FROM c),
correction AS {_found_sql("c AS (SELECT word, c0, c1, c2, c3, c0 + c1 + c2 + c3 AS total FROM train WHERE c0 + c1 + c2 + c3 > 0), t AS (SELECT CAST(sum(c0) AS DOUBLE) AS n0, CAST(sum(c1) AS DOUBLE) AS n1, CAST(sum(c2) AS DOUBLE) AS n2, CAST(sum(c3) AS DOUBLE) AS n3, CAST(sum(total) AS DOUBLE) AS n, count(*) AS v FROM c)")},
n AS (SELECT (SELECT count(*) FROM diagnostic) AS n_diagnostic, (SELECT count(*) FROM correction) AS n_correction, (SELECT count(*) FROM diagnostic SEMI JOIN correction USING (word)) AS n_both)
SELECT n_diagnostic, n_correction, n_both, round(coalesce(n_both / nullif(n_diagnostic + n_correction - n_both, 0), 0), 6) AS ratio FROM n""")
def corpora_bridges(spark, d):
    """Diagnostic bridge words (negative cases) against those for correction (training cases), and their overlap."""
    by_mask = _masked(spark, d)
    (neg, _), (train, five) = _table(by_mask, "ABUSE_NEG"), _table(by_mask, "TRAIN")
    o = corpora.bridge_overlap(corpora.diagnostic_bridges(neg, ABUSE_ORDER), corpora.correction_bridges(train, five, ABUSE_ORDER))
    return o.withColumn("ratio", F.round("ratio", 6))
