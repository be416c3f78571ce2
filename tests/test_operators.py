"""Values worked out by hand or by NumPy, edge rules and invariants."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyloom.constants import BRIDGE_CONFIGS
from tallyloom.functions import arrays as ar
from tallyloom.functions import labels as lb
from tallyloom.functions import special
from tallyloom.functions import text as tx
from tallyloom.operators import assoc, bridge, counts, evaluate, geometry, ml, oversight, resample, windows
from tallyloom.sources import records, sinks
from tallyloom.streaming import word_counts

K4 = ["k0", "k1", "k2", "k3"]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([("w1", 8, 6, 0, 0, 14), ("w2", 1, 2, 9, 8, 20), ("w3", 5, 5, 5, 5, 20)], "word string, c0 int, c1 int, c2 int, c3 int, total int")


def one(df, key="word"):
    return {r[key]: r for r in df.collect()}


def test_chi2_and_fdr(wide):
    got = one(assoc.bh_fdr(assoc.word_chi2(wide, 4, p_value=True)))
    for w, chi2, p, q in (("w1", 14.313972, 0.002507, 0.007522), ("w2", 9.937363, 0.019106, 0.028659), ("w3", 0.027473, 0.998799, 0.998799)):
        assert (round(got[w].chi2, 6), round(got[w].p_value, 6), round(got[w].p_fdr_bh, 6)) == (chi2, p, q)


def test_log_odds_and_hhi(wide):
    odds = {(r.word, r.grp): r for r in assoc.log_odds(wide, K4).collect()}
    assert [round(odds["w1", k].log_odds, 6) for k in K4] == [2.019127, 1.261084, -6.626561, -6.514851]
    assert [round(odds["w1", k].z, 6) for k in K4] == [3.741478, 2.336811, -0.662420, -0.651253]
    assert [round(odds["w3", k].log_odds, 6) for k in K4] == [-0.07705, 0.079646, -0.07705, 0.079646]
    assert [round(one(assoc.hhi(wide, K4), "grp")[k].hhi, 6) for k in K4] == [0.459184, 0.384615, 0.540816, 0.526627]


def test_bridges(wide):
    t = one(assoc.top2(wide, K4))
    assert (t["w1"].primary, t["w1"].secondary, round(t["w1"].p1, 6)) == ("k0", "k1", 0.571429) and (t["w3"].primary, t["w3"].secondary) == ("k0", "k1")
    found = {c: set(one(bridge.prob_bridge(wide, K4, cfg, 5))) for c, cfg in BRIDGE_CONFIGS.items()}
    assert found == {"B0": {"w1", "w2"}, "loose": {"w1", "w2"}, "strict": {"w1", "w2"}} and found["strict"] <= found["B0"] <= found["loose"]
    edge = wide.sparkSession.createDataFrame([("e", 55, 35, 10, 0, 100)], wide.schema)
    assert bridge.prob_bridge(edge, K4, BRIDGE_CONFIGS["B0"], 5).count() == 0  # 0.55 - 0.35 exceeds 0.2 in doubles


def test_special_functions():
    assert abs(special.chi2_sf_value(14.313972, 3) - 0.002507) < 1e-6 and abs(special.chi2_sf_value(3.841459, 1) - 0.05) < 1e-6
    assert abs(special.chi2_sf_value(9.487729, 4) - 0.05) < 1e-6 and special.chi2_sf_value(0, 3) == 1
    assert abs(special.f_sf_value(4.102821, 2, 10) - 0.05) < 1e-6 and abs(special.t_two_sided_value(2.228139, 10) - 0.05) < 1e-6


def test_text(spark):
    d = spark.createDataFrame([(1, "나는 학교 학교 좀 a")], "id int, t string")
    assert d.select(tx.tokens(tx.clean(F.col("t")))).first()[0] == ["나는", "학교", "학교"]
    s = spark.createDataFrame([("가. 나?다  라",), ("",)], "t string").select(tx.sentences(F.col("t")).alias("s"))
    assert [r.s for r in s.collect()] == [["가", "나", "다", "라"], []]


def test_qa_pairs(spark):
    rows = [(1, 0, "Q", "Q1"), (1, 1, "A", "A1"), (1, 2, "A", "A2"), (2, 0, "A", "A3"), (2, 1, "Q", "x"), (2, 2, "Q", "y"), (2, 3, "A", "A4")]
    got = tx.qa_pairs(spark.createDataFrame(rows, "g int, pos int, kind string, text string"), ["g"], "pos", "kind", "text").orderBy("g", "pos").collect()
    assert [(r.question, r.answer) for r in got] == [("Q1", "A1"), ("(질문 없음)", "A2"), ("(질문 없음)", "A3"), ("y", "A4")]


def record(ident, items=(), crisis=None, total=None, gt=None, clinical=None, questions=()):
    audio = [{"type": "A", "text": " 말 "}, {"type": "Q", "text": "물음"}, {"type": "A", "text": " "}]
    qs = [{"문항": "학대여부", "문항합계": "x", "list": [{"항목": n, "점수": s, "audio": audio} for n, s in items]}]
    qs += [{"문항": n, "문항합계": s, "list": []} for n, s in questions]
    return {"info": {"ID": ident, "위기단계": crisis, "합계점수": total, "학대의심": gt, "임상진단": clinical}, "list": qs}


def test_scores_are_sums_of_the_abuse_question(spark):
    """Several items of a class add up, items of other questions don't count; the last total of a question decides."""
    question = lambda name, total, *items: (name, total, [(n, s, []) for n, s in items])
    rows = [
        (1, [question("학대여부", "1", ("신체학대", "3"), ("신체학대 정도", "4"), ("방임", "x"), ("방임 정도", " 2 ")), question("기타", "9", ("신체학대", "50")), question("학대여부", "7", ("정서학대", "1"))]),
        (2, [question("학대여부", "5"), question("학대여부", "없음")]), (3, []), (4, [question("학대여부", "3.7", ("성학대", "2.5"))]),
    ]
    t = spark.createDataFrame(rows, StructType([StructField("id", IntegerType()), StructField("items", records.QUESTIONS)]))
    got = {r.id: (r.scores, r.q) for r in t.select("id", lb.class_scores(F.col("items")).alias("scores"), lb.question_sum(F.col("items"), "학대여부").alias("q")).collect()}
    assert got == {1: ([0, 7, 1, 2], 7), 2: ([0, 0, 0, 0], 0), 3: ([0, 0, 0, 0], 0), 4: ([0, 0, 0, 0], 0)}


def test_tfidf_weighs_by_one_plus_idf(spark):
    import math

    from tallyloom.operators import ml

    rows = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a"],)], "toks array<string>")
    model = ml.tfidf(min_df=1, bigrams=False).fit(rows)
    words = model.stages[1].vocabulary
    got = model.transform(rows).select("features").collect()[0][0].toArray()
    raw = {"a": 1.0, "b": math.log(4 / 2) + 1}
    size = math.hypot(*raw.values())
    assert all(abs(got[words.index(w)] - raw[w] / size) < 1e-9 for w in raw)
    assert len(ml.tfidf(min_df=9, bigrams=False).fit(rows).stages[1].vocabulary) == 2  # none is frequent enough: all count


def test_two_groups():
    import numpy as np

    from tallyloom.operators import spaces

    larger, smaller = np.array([3.0, 4.0, 5.0, 5.0]), np.array([1.0, 2.0, 3.0])
    u, p = spaces.rank_test(larger, smaller)
    assert u == sum((a > b) + 0.5 * (a == b) for a in larger for b in smaller) and 0.01 < p < 0.06
    assert abs(spaces.effect_size(larger, smaller) - (4.25 - 2) / ((4 * larger.var() + 3 * smaller.var()) / 7) ** 0.5) < 1e-12
    x = np.vstack([np.random.default_rng(1).normal(0, 0.1, (10, 2)), np.random.default_rng(2).normal(3, 0.1, (10, 2))])
    r = spaces.two_groups(x, np.arange(20) < 10, 199)
    assert r["p_perm"] == 1 / 200 and r["cohens_d"] > 5 and r["mean_between"] > r["mean_within"]


def test_records(spark, tmp_path):
    data = [
        record("a", gt="신체학대"), record("b", crisis="정상군"), record("c", [("자해/자살", 1)], "정상군"), record("d", [("신체학대 항목", 8), ("정서학대 항목", 5), ("방임 항목", "12")], total="abc"),
        record("e", [("정서학대", 5)], clinical="정서학대"), record("f", gt=["방임", {"val": "성적 학대"}]), record("g", gt="신체학대, 정서적 학대"), record("h", total=" 12 ", questions=[("학대여부", "3"), ("학대여부", "5")]),
    ]
    (tmp_path / "1.json").write_text(json.dumps(data[0], ensure_ascii=False))
    (tmp_path / "2.json").write_text(json.dumps(data[1:], ensure_ascii=True))
    (tmp_path / "3.json").write_text('{"info": ')
    (tmp_path / "4.json").write_text('{"other": 1}')
    (tmp_path / "5.txt").write_text("no")
    scanned = records.scan(spark, str(tmp_path))
    got = {r.doc_id: r for r in records.labelled(scanned).collect()}
    assert set(got) == set("abcdefgh")
    assert {k: r.valence for k, r in got.items()} == {"a": "부정", "b": "긍정", "c": "부정", "d": "긍정", "e": "긍정", "f": "부정", "g": "부정", "h": "긍정"}
    assert (got["a"].main, got["a"].subs, got["b"].main) == ("신체학대", [], None)
    assert (got["d"].main, got["d"].subs, got["d"].tier) == ("방임", ["신체학대", "정서학대"], "CLEAR")
    assert (got["e"].main, got["e"].subs) == ("정서학대", ["정서학대"])
    assert got["f"].gt == ["방임"] and got["g"].gt == ["신체학대", "정서학대"] and got["g"].main == "신체학대"
    assert got["c"].said == ["말"] and got["a"].in_abuse_neg and not got["b"].in_neg
    assert all(r.in_neg for r in got.values() if r.in_gt)
    q = scanned.where("info.ID = 'h'").select(lb.question_sum(F.col("list"), "학대여부"), F.trim("info.합계점수").try_cast("int")).first()
    assert tuple(q) == (5, 12)


def test_doc_id_normal(spark):
    d = spark.createDataFrame([("12.0",), ("007",), (" x1 ",), ("0",)], "i string").select(lb.doc_id_normal(F.col("i")).alias("n"))
    assert [r.n for r in d.collect()] == ["12", "7", "x1", "0"]


def test_arrays(spark):
    d = spark.createDataFrame([([3, 1, 0, 0], ["b", "a"], ["a"]), ([0, 0, 0, 0], [], [])], "s array<int>, y array<string>, p array<string>")
    p = ar.distribution(F.col("s"))
    r = d.select(ar.entropy(p).alias("h"), ar.soft_label(F.col("s")).alias("soft"), ar.jaccard(F.col("y"), F.col("p")).alias("j"), ar.error_type(F.col("y"), F.col("p")).alias("e"), ar.labels_to_string(F.col("y"), ["a", "b"]).alias("l")).collect()
    assert round(r[0].h, 6) == 0.811278 and r[1].soft is None and (r[0].j, r[1].j) == (0.5, 1.0)
    assert [x.e for x in r] == ["under", "exact"] and r[0].l == "a|b"
    soft = r[0].soft
    assert abs(sum(soft) - 1) < 1e-12 and round(-sum(x * math.log(x) for x in soft), 6) == 1.075139


def test_weighted_counts(spark):
    d = spark.createDataFrame([("m", ["m", "s"], ["x", "x"]), ("s", [], ["x"])], "main string, subs array<string>, toks array<string>")
    r = counts.weighted_counts(d, F.col("toks"), F.col("main"), F.col("subs"), 0.5, ["m", "s"], 0).first()
    assert (r.c0, r.c1, r.total) == (1.0, 1.5, 2.5)


def test_windows(spark):
    d = spark.createDataFrame([(w, v) for w, v in zip("abcdefgh", [1, 1, 1, 2, 3, 4, 5, 9])], "w string, v int")
    bins = {r.w: r.bin for r in windows.quantile_bins(d, "v", 4).collect()}
    edges = sorted(set(np.quantile([1, 1, 1, 2, 3, 4, 5, 9], [0, 0.25, 0.5, 0.75, 1])))
    assert bins == {w: max(1, sum(e < v for e in edges)) for w, v in zip("abcdefgh", [1, 1, 1, 2, 3, 4, 5, 9])}
    f = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("l"))
    a = {r.id: r.fold for r in windows.folds(f, "id", "l").collect()}
    assert a == {r.id: r.fold for r in windows.folds(f.repartition(7), "id", "l").collect()}
    assert all(30 <= sum(a[i] == k for i in range(0, 1000, 4)) <= 70 for k in range(5))


def test_permutation_is_deterministic_and_valid(spark):
    docs = spark.createDataFrame([(i, K4[i % 4]) for i in range(200)], "doc_id int, grp string")
    words = spark.createDataFrame([(i, "tied") for i in range(0, 200, 4)] + [(i, "free") for i in range(0, 200, 5)], "doc_id int, word string")
    run = lambda d: {r.word: r for r in resample.permutation_chi2(d, words, K4, n=30).collect()}
    a, b = run(docs), run(docs.repartition(5))
    assert {w: r.p_perm for w, r in a.items()} == {w: r.p_perm for w, r in b.items()}
    assert a["tied"].p_perm == 1 / 31 and 0 < a["free"].p_perm <= 1 and a["free"].p_perm > 0.1


def test_bootstrap(spark):
    docs = spark.createDataFrame([(i, K4[i % 4]) for i in range(400)], "doc_id int, grp string")
    words = spark.createDataFrame([(i, "both") for i in range(400) if i % 4 < 2] + [(i, "single") for i in range(0, 400, 4)], "doc_id int, word string")
    got = {r.word: r for r in resample.bridge_bootstrap(docs, words, K4, n=40).collect()}
    assert got["both"].B0 > 0.8 and got["single"].B0 == 0


def test_geometry(spark, wide):
    words, x = geometry.matrix(wide, K4)
    ca = geometry.correspondence(x)
    p = x / x.sum()
    e = np.outer(p.sum(1), p.sum(0))
    assert words == ["w1", "w2", "w3"] and abs(ca["chi2"] - (x.sum() * ((p - e) ** 2 / e).sum())) < 1e-9
    full = geometry.correspondence(x, 3)
    assert np.allclose(p.sum(1) @ full["rows"], 0) and np.allclose(x.T / x.sum(0)[:, None] @ full["rows"], full["cols"] * np.sqrt(ca["inertia"][:3]))
    a = np.random.default_rng(0).normal(size=(6, 2))
    turn = np.array([[0.0, -1], [1, 0]])
    assert abs(geometry.procrustes(a, 3 * a @ turn + 1)) < 1e-9 and abs(geometry.procrustes(a, 3 * a @ turn + 1, True)) < 1e-9
    assert geometry.plain_r2(a, a) == 1 and geometry.mantel(np.abs(a @ a.T), np.abs(a @ a.T), 19)[0] > 0.999
    assert geometry.convex_hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert np.allclose(geometry.pca2(a).mean(0), 0)


def test_correction(spark):
    d = spark.createDataFrame([([0.5, 0.3, 0.2], [1.0, 0.0, -1.0], [0.0, 0.0, 0.0])], "p array<double>, e array<double>, g array<double>")
    r = d.select(oversight.correct_log_linear(F.col("p"), F.col("e")).alias("a"), oversight.correct_additive(F.col("p"), F.col("e"), F.col("g")).alias("c"), oversight.assemble(F.col("p"), F.lit("z"), ["x", "y", "z"]).alias("s")).first()
    w = np.array([0.5, 0.3, 0.2]) * np.exp([1, 0, -1])
    assert np.allclose(r.a, w / w.sum()) and np.allclose(r.c, np.array([1, 0.3, 0]) / 1.3) and r.s == ["z", "x"]


def test_top_k_fallback(spark):
    d = spark.createDataFrame([([0.1, 0.3, 0.2],), ([0.9, 0.8, 0.1],)], "s array<double>")
    assert [r.t for r in d.select(evaluate.top_k_labels(F.col("s"), ["x", "y", "z"], 0.5, 2).alias("t")).collect()] == [["y", "z"], ["x", "y"]]


def test_classifier(spark):
    rows = [(i, "ab"[i % 2], (["tree", "leaf"] if i % 2 else ["sea", "wave"]) + [f"w{i % 7}"]) for i in range(60)]
    out = ml.cross_validate(spark.createDataFrame(rows, "doc_id int, l string, toks array<string>"), "l", k=2)
    assert out.count() == 60 and out.where("truth = pred").count() > 55


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, score double")
    sinks.write_csv(d, str(tmp_path / "c"), single=True)
    assert records.read_csv(spark, str(tmp_path / "c")).count() == 2
    sinks.json_report(d, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[1] == {"name": "b", "score": 2.0}
    assert r"\textbf{2.0000}" in sinks.latex_table(d) and r"\textbf{1.0000}" in sinks.latex_table(d, {"score"})
    assert sinks.markdown_table(d).splitlines()[2] == "| a | 1.0000 |"
    with pytest.raises(ValueError):
        sinks.json_report(d, str(tmp_path / "x.json"), most=1)
    cache = sinks.JsonCache(str(tmp_path / "cache.json"))
    cache.data["k"] = "v"
    cache.save()
    assert sinks.JsonCache(str(tmp_path / "cache.json")).data == {"k": "v"} and sinks.output_dirs("o", "NEG")["ca"] == "o/NEG/ca"


def test_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    counts_ = word_counts.windowed_counts(word_counts.stream_table(spark, str(tmp_path / "in"), e), "ts", F.col("event_type"), "1 day")
    word_counts.run_once(counts_, str(tmp_path / "cp"), "streamed")
    want = {(str(r.d), r.event_type): r["count"] for r in e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").count().collect()}
    assert {(str(r.start), r.key): r.n for r in spark.table("streamed").collect()} == want


def test_label_models(spark):
    rows = [(i, ["a"] * (i % 2 == 0) + ["b"] * (i % 3 == 0), (["tree"] if i % 2 == 0 else ["sea"]) + (["dog"] if i % 3 == 0 else ["cat"]), [2.0 * (i % 2 == 0) + 1, 1.0]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id int, y array<string>, toks array<string>, s array<double>").withColumn("soft", ar.soft_label(F.col("s")))
    chain = {r.doc_id: r for r in ml.classifier_chain(d, ["a", "b"], "y", k=2).collect()}
    assert len(chain) == 60 and all((chain[i].p_a > 0.5) == (i % 2 == 0) and (chain[i].p_b > 0.5) == (i % 3 == 0) for i in range(60))
    q = {r.doc_id: r.q for r in ml.soft_label_ridge(d, "soft", ["x", "y"], k=2).collect()}
    assert all(abs(sum(v) - 1) < 1e-9 for v in q.values()) and all((q[i][0] > 0.6) == (i % 2 == 0) for i in range(60))


def test_bridge_scores(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, m string")
    weights = spark.createDataFrame([(1, "w", 0.5), (2, "w", 0.5), (3, "w", 1.0), (1, "v", 1.0)], "doc_id int, word string, weight double")
    br = spark.createDataFrame([("w", "a", "b", 0.4), ("v", "c", "a", 0.3)], "word string, primary string, secondary string, p2 double")
    got = {r.doc_id: (round(r.b_a, 6), round(r.b_b, 6), round(r.b_c, 6)) for r in ml.bridge_scores(docs, weights, br, "m", ["a", "b", "c"]).collect()}
    assert got == {1: (0.0, 0.2, 0.3), 2: (0.2, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_word_vectors(spark):
    d = spark.createDataFrame([(["x", "y", "z"],)] * 10, "toks array<string>")
    assert {r.word: len(r.vector) for r in ml.word_vectors(d, size=8, iterations=1).collect()} == {"x": 8, "y": 8, "z": 8}


def test_registered_jobs_are_whole(spark, monkeypatch):
    """The queries ask for the reference's iterations, clusters, folds and words."""
    from tallyloom.plans import models

    asked = {}
    for module, name in ((models.resample, "permutation_chi2"), (models.resample, "bridge_bootstrap"), (models.resample, "bridge_null"), (models.geometry, "kmeans_soft_table"), (models.ml, "cross_validate")):
        def note(first, *rest, f=getattr(module, name), name=name, **kw):
            asked[name] = (kw, rest)
            return f(first, *rest, **kw)

        monkeypatch.setattr(module, name, note)
    d = "/root/testdata/sf0.001"
    models.bridge_bootstrap(spark, d), models.null_summary(spark, d), models.permutation_chi2(spark, d), models.kmeans_soft_table(spark, d)
    assert [asked[n][0]["n"] for n in ("permutation_chi2", "bridge_bootstrap", "bridge_null")] == [1000, 200, 1000]
    assert asked["permutation_chi2"][0]["min_docs"] == 5 and asked["kmeans_soft_table"][0]["k"] == 200
    on = asked["permutation_chi2"][1][0].groupBy("word").count()
    assert on.where("count between 5 and 19").count() > 0  # no filter before the operator's own
    monkeypatch.setattr(models.ml, "cross_validate", lambda *a, **kw: asked.update(cv=kw) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.tfidf_cv_lr(spark, d)
    assert asked["cv"]["k"] == 5


def _odds(spark, seed=4, words=150):
    """Log-odds of words over four classes with distances of all sizes, some not finite, and plain rows of them."""
    import random

    rng, rows = random.Random(seed), []
    for w in range(words):
        lead, gap = rng.uniform(0.5, 3), rng.choice([0.2, 0.5, 0.7, 0.9, 1.1, 1.4, 1.9])
        values = [lead, lead - gap, lead - gap - rng.uniform(0.1, 1), -1.0]
        for k in range(4):
            z = rng.choice([float("inf"), 0.5, 2.5, 3.0])
            rows.append((f"w{w}", f"k{(k + w) % 4}", (k + w) % 4, rng.randint(3, 30), values[k] if rng.random() > 0.02 else float("-inf"), z))
    return rows, spark.createDataFrame(rows, "word string, grp string, rank int, cnt long, log_odds double, z double")


def _delta_plain(rows, delta, min_logodds=1.0, min_count=5, min_total=None, z_min=None, positive=True, strict_z=True):
    import math
    from collections import defaultdict

    by, out = defaultdict(list), {}
    for word, grp, rank, cnt, lo, z in rows:
        if math.isfinite(lo):
            by[word].append((-lo, rank, grp, cnt, z))
    for word, cells in by.items():
        total, two = sum(c[3] for c in cells), sorted(cells)[:2]
        if len(two) < 2 or (min_total is not None and total < min_total) or -two[0][0] + two[1][0] >= delta:
            continue
        fine = lambda c: -c[0] >= min_logodds and c[3] >= min_count and (-c[0] > 0 or not positive) and (z_min is None or (c[4] >= z_min if math.isfinite(c[4]) else not strict_z))
        if all(map(fine, two)):
            out[word] = (tuple(sorted((two[0][2], two[1][2]))), total)
    return out


def test_delta_bridges_match_plain_code(spark):
    from tallyloom.operators import bridge

    rows, odds = _odds(spark)
    for rule in ({}, {"z_min": 1.0}, {"z_min": 1.0, "strict_z": False, "min_total": 50}, {"min_logodds": -9.0, "positive": False, "min_count": 0}):
        got = {r.word: (tuple(sorted((r.primary, r.secondary))), r.total) for r in bridge.delta_bridge(odds, 1.2, **rule).collect()}
        assert got == _delta_plain(rows, 1.2, **rule) and got
    deltas, base = [0.1, 0.6, 1.0, 1.5], _delta_plain(rows, 1.0)
    first = lambda d: {w for w, _ in sorted(d.items(), key=lambda x: (-x[1][1], x[0]))[:10]}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else None
    pairs = {}
    summary = {r.delta: r for r in bridge.delta_summary(odds, deltas, 1.0, 10).collect()}
    for x in deltas:
        here = _delta_plain(rows, x)
        r = summary[x]
        assert r.n_bridge == len(here) and abs(r.ratio - len(here) / 150) < 1e-12 and r.jaccard == jac(set(here), set(base))
        assert r.jaccard_top == (jac(first(here), first(base)))
        for p, _ in here.values():
            pairs[x, *p] = pairs.get((x, *p), 0) + 1
    assert {(r.delta, r.a, r.b): r.n for r in bridge.delta_pairs(odds, deltas).collect()} == pairs
    assert len({summary[x].n_bridge for x in deltas}) == 4
    nothing = bridge.delta_summary(odds.where("false"), deltas, 1.0).collect()
    assert sorted((r.delta, r.n_bridge, r.ratio, r.jaccard) for r in nothing) == [(x, 0, 0.0, None) for x in deltas]


def test_config_tests_give_welch(spark):
    """Welch's test and the tail shares against a direct computation; null where a side has fewer than two words."""
    import statistics as st

    from tallyloom.functions.special import t_two_sided_value
    from tallyloom.operators import bridge

    rows = [(f"w{i}", a, 10 - a, 10, float(x), x / 10) for i, (a, x) in enumerate([(5, 1), (5, 4), (6, 2), (9, 8), (9, 3), (10, 5), (8, 9)])]
    stats = spark.createDataFrame(rows, "word string, c0 long, c1 long, total long, chi2 double, p_value double")
    got = {r.config: r for r in bridge.config_tests(stats, ["a", "b"], {"near": (0.4, 0.25, 0.25), "none": (0.99, 0.99, 0.0)}, 0).collect()}
    on, off = [1, 4, 2], [8, 3, 5, 9]
    v1, v2 = st.variance(on) / 3, st.variance(off) / 4
    t, df = (st.mean(on) - st.mean(off)) / (v1 + v2) ** 0.5, (v1 + v2) ** 2 / (v1**2 / 2 + v2**2 / 3)
    r = got["near"]
    assert (r.median_bridge, r.median_other, r.n_sig_05, r.n_sig_01) == (2, 6.5, 0, 0)
    assert abs(r.t_stat - t) < 1e-9 and abs(r.df - df) < 1e-9 and abs(r.p_value - t_two_sided_value(t, df)) < 1e-9
    assert got["none"].t_stat is None and got["none"].median_bridge is None and got["none"].share_sig_05 is None


def test_gram_analysis_is_the_decomposition(spark):
    """Class points, inertia, chi-square and words from sums by pairs of classes against the whole matrix in NumPy."""
    rng = np.random.default_rng(4)
    x = rng.poisson(3, (500, 4))
    x[:7] = 0
    x[7:20, 1:] = 0
    rows = [(f"w{i:03}", *map(int, r), int(r.sum()), bool(i % 5 == 0)) for i, r in enumerate(x)]
    wide = spark.createDataFrame(rows, "word string, c0 int, c1 int, c2 int, c3 int, total int, f boolean")
    one = geometry.gram_sums(wide, K4, {"cut": "f"}).first()
    used = x.sum(1) > 0
    for name, keep in (("all", used), ("cut", used & (np.arange(500) % 5 != 0))):
        want, got = geometry.correspondence(x[keep].T.astype(float), 3), geometry.gram_correspondence(one, name, 4, 3)
        assert got["words"] == keep.sum() and got["df"] == 3 * (keep.sum() - 1)
        assert np.allclose(got["rows"], want["rows"], atol=1e-7) and np.allclose(got["inertia"][:3], want["inertia"][:3]) and abs(got["chi2"] / want["chi2"] - 1) < 1e-9
    full = {(r.kind, r.name): (r.dim1, r.dim2) for r in geometry.ca_full(wide, K4).collect()}
    want = geometry.correspondence(x[used].T.astype(float))
    bary = geometry.barycentric(x.T.astype(float), want["rows"])
    assert len(full) == 4 + used.sum() and all(np.allclose(full["word", f"w{i:03}"], bary[i], atol=1e-7) for i in np.flatnonzero(used))
    ca = geometry.gram_correspondence(one, "all", 4)
    words = {r.word: (r.dim1, r.dim2) for r in geometry.project_words(wide, K4, ca["rows"], ca["inertia"]).collect()}
    assert all(np.allclose(words[f"w{i:03}"], want["cols"][n], atol=1e-7) for n, i in enumerate(np.flatnonzero(used)))
    ablation = {r.variant: r for r in geometry.ca_ablation(wide, K4, {"cut": "f"}).collect()}
    assert ablation["all"].disparity < 1e-12 and abs(ablation["cut"].disparity - geometry.procrustes(want["rows"], geometry.correspondence(x[used & (np.arange(500) % 5 != 0)].T.astype(float))["rows"])) < 1e-9
    assert abs(geometry.chi2_sf_large(330.0, 301) - 0.1199) < 5e-3 and geometry.chi2_sf_large(5.0, 0) == 1.0 and 0.4 < geometry.chi2_sf_large(1e5, 100_000) < 0.5
    empty = geometry.gram_correspondence(geometry.gram_sums(wide.where("false"), K4).first(), "all", 4)
    assert empty["words"] == 0 and empty["chi2"] == 0 and empty["p"] == 1


def test_corpora_from_one_count(spark):
    from tallyloom.operators import corpora

    rows = [(i, K4[i % 4] if i % 5 else "none", i % 3 == 0, None if i % 7 == 0 else i % 2 == 0, [f"w{i % 6}", f"w{i % 6}", f"v{i % 11}"]) for i in range(200)] + [(200, None, True, True, ["w1"])]
    docs = spark.createDataFrame(rows, "doc_id int, label string, a boolean, b boolean, toks array<string>")
    sets = {"a": F.col("a"), "b": F.col("b"), "every": F.lit(True)}
    by_mask = corpora.counts_by_membership(docs, F.col("toks"), "label", [*K4, "none"], sets)
    for name, test in (("a", lambda r: r[2]), ("b", lambda r: r[3]), ("every", lambda r: True)):
        for among in ([*K4, "none"], ["k2", "k0"]):
            got = {r.word: tuple(r)[1:] for r in corpora.corpus_counts(by_mask, list(sets), name, [*K4, "none"], among, 3).collect()}
            want = {}
            for r in rows:
                if test(r) and r[1] in among:
                    for w in set(r[4]):
                        want.setdefault(w, [0] * len(among))[among.index(r[1])] += 1
            assert got == {w: (*c, sum(c)) for w, c in want.items() if sum(c) >= 3}


def test_csv_with_a_mark(spark, tmp_path):
    d = spark.createDataFrame([("a,b", 1), ("여", 2)], "name string, n int")
    sinks.write_csv(d, str(tmp_path / "m"), single=True, bom=True)
    raw = next((tmp_path / "m").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname,n") and raw.decode("utf-8-sig").splitlines() == ["name,n", '"a,b",1', "여,2"]


def test_bridge_evidence_does_not_depend_on_the_order_of_rows(spark):
    wide = spark.createDataFrame([("a", 1, 9, 10), ("b", 2, 8, 10), ("c", 3, 7, 10)], "word string, c0 int, c1 int, total int")
    orders = [["a", "b", "c"], ["c", "b", "a"], ["b", "c", "a"], ["c", "a", "b"]]
    docs = spark.createDataFrame(list(enumerate(orders)), "doc_id int, toks array<string>")
    got = oversight.evidence_bridge(docs, F.col("toks"), wide, wide, 2).collect()
    low, high = (1 / 10 + 2 / 10 + 3 / 10) / 3, (7 / 10 + 8 / 10 + 9 / 10) / 3
    assert {(r.n_bridge, *r.g) for r in got} == {(3, low / (low + high), high / (low + high))}


@pytest.mark.parametrize("name", ["correction_c", "correction_grid"])
def test_corrections_count_the_corpus_once(spark, monkeypatch, name):
    from tallyloom.plans import base, models, sweeps

    calls, counted = [], base.counts_k4
    monkeypatch.setattr(base, "counts_k4", lambda *a, **kw: calls.append(1) or counted(*a, **kw))
    (models.QUERIES | sweeps.QUERIES)[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_counts_of_one_pass(spark):
    """Both counts, and weights of any alpha, from one count each, as the separate ones give them."""
    rows = [(1, "a", ["b", "b", "c"], ["x", "y", "x"]), (2, "b", ["a", "d"], ["y", "y"]), (3, "a", [], ["y"]), (4, "b", ["b"], []), (5, "c", None, None), (6, None, ["a"], ["x"])]
    d = spark.createDataFrame(rows, "doc_id int, main string, subs array<string>, toks array<string>")
    row = lambda t, cs: {r.word: [round(float(r[c]), 9) for c in cs] for r in t.collect()}
    both = counts.both_counts(d, F.col("toks"), "main", ["a", "b", "c"], 1)
    cs = ["c0", "c1", "c2", "total"]
    assert row(both, cs) == row(counts.doc_counts(d, F.col("toks"), "main", ["a", "b", "c"], 1), cs)
    assert row(both, ["t0", "t1", "t2"]) == row(counts.token_counts(d, F.col("toks"), "main", ["a", "b", "c"], 1), ["c0", "c1", "c2"])
    known = d.where("main is not null")
    once = counts.main_and_sub_counts(known, F.col("toks"), F.col("main"), F.col("subs"), ["a", "b", "c"])
    for alpha in (0.0, 0.3, 1.0):
        assert row(counts.weighted(once, alpha, ["a", "b", "c"], 1), cs) == row(counts.weighted_counts(known, F.col("toks"), F.col("main"), F.col("subs"), alpha, ["a", "b", "c"], 1), cs)


def test_words_that_meet_are_counted_without_moving_rows_by_word(spark):
    """Pairs equal plain code's; no join has a row's words beside one of them."""
    from itertools import product

    from tallyloom.operators import windows

    rows = [(i, sorted({f"w{(i * j) % 7}" for j in range(1, 5)} | {f"once{i}"})) for i in range(30)] + [(30, []), (31, None)]
    docs, chosen = spark.createDataFrame(rows, "row long, toks array<string>"), spark.createDataFrame([("w1",), ("w3",), ("once2",), ("gone",)], "word string")
    got = windows.met_words(docs, "row", "toks", chosen, 3)
    plain = {}
    for _, ws in rows:
        for a, b in product(ws or [], ws or []):
            if a != b and a in ("w1", "w3", "once2"):
                plain[a, b] = plain.get((a, b), 0) + 1
    assert {(r.word, r.other): r.n for r in got.collect()} == {k: n for k, n in plain.items() if n >= 3}

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    from tallyloom.plans import words

    plan = words.bridge_cooccur(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes(plan) if n.nodeName() == "Join"]
    assert joins and not any("array<string>" in n.children().apply(i).schema().catalogString() for n in joins for i in (0, 1))
