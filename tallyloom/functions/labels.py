"""Labelling rules as decision lists of column expressions; no row leaves the JVM.

A record is a row with the columns of ``sources.records``: ``info`` (struct) and ``list`` (array of questions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.constants import ABUSE_ORDER, CRISIS_NEGATIVE, CRISIS_NEUTRAL, CRISIS_POSITIVE, GT_CANON, MAIN_THRESHOLD, SUB_THRESHOLD
from tallyloom.functions.arrays import by_rank

def _classes() -> Column:
    return F.array(*map(F.lit, ABUSE_ORDER))


def question_sum(items: Column, name: str) -> Column:
    """The total of the last question of that name; 0 if there is none or it isn't a whole number."""
    hits = F.filter(items, lambda q: q["문항"] == name)
    return F.coalesce(F.get(F.transform(F.reverse(hits), lambda q: F.trim(q["문항합계"]).try_cast("int")), F.lit(0)), F.lit(0))


def item_max(items: Column, name: str) -> Column:
    """The largest score of the items of that name over all questions; 0 if none has a whole number."""
    scores = F.flatten(F.transform(items, lambda q: F.transform(F.filter(q["list"], lambda i: i["항목"] == name), lambda i: i["점수"].try_cast("int"))))
    return F.coalesce(F.array_max(scores), F.lit(0))


def class_scores(items: Column) -> Column:
    """For each class, most severe first, the sum of the scores of the abuse question's items whose name contains it."""
    asked = F.flatten(F.transform(F.filter(items, lambda q: q["문항"] == "학대여부"), lambda q: q["list"]))
    score = lambda i: F.coalesce(F.trim(i["점수"]).try_cast("int"), F.lit(0))
    each = lambda c: F.transform(F.filter(asked, lambda i: F.contains(i["항목"], F.lit(c))), score)
    return F.array(*(F.coalesce(F.aggregate(each(c), F.lit(0), lambda a, x: a + x), F.lit(0)) for c in ABUSE_ORDER))


def score_of(label: Column, scores: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.arrays_zip(_classes().alias("c"), scores.alias("s")), lambda x: x["c"] == label)["s"], F.lit(0)), F.lit(0))


def keywords(clinical: Column) -> Column:
    """The classes that a clinical text names."""
    return F.filter(_classes(), lambda c: F.contains(F.coalesce(clinical, F.lit("")), c))


def sub_source(sub: Column, scores: Column, named: Column, tau: int = SUB_THRESHOLD) -> Column:
    """both, score, clinical or unknown: what gave a case a secondary label."""
    by_score, by_text = score_of(sub, scores) >= tau, F.array_contains(named, sub)
    return F.when(by_score & by_text, "both").when(by_score, "score").when(by_text, "clinical").otherwise("unknown")


def case_type(gt: Column, main: Column, subs: Column, sources: Column) -> Column:
    """A: right main label and others; B: ground truth among the others; C: another from the text; D: right and alone; E: else."""
    right = F.coalesce(gt == main, F.lit(False))
    of_text = F.exists(sources, lambda s: s.isin("clinical", "both"))
    return F.when(right & (F.size(subs) > 0), "A").when(~right & F.coalesce(F.array_contains(subs, gt), F.lit(False)), "B").when(of_text, "C").when(right, "D").otherwise("E")


def simple_valence(crisis: Column, total: Column, harm: Column, happy: Column, worry: Column, abuse_q: Column, mood_q: Column, life_q: Column, urgent_q: Column) -> Column:
    """The valence without ground truth and without protective signs: the first rule that holds decides."""
    risk = mood_q + life_q + abuse_q + urgent_q
    calm = (happy == 0) & (worry == 0) & (abuse_q == 0) & (crisis.isNull() | crisis.isin(CRISIS_POSITIVE, CRISIS_NEUTRAL))
    return (
        F.when((harm > 0) | (happy >= 7), "부정").when(calm, "긍정")
        .when(crisis.isin(CRISIS_NEGATIVE), "부정").when(crisis == CRISIS_POSITIVE, "긍정").when(crisis == CRISIS_NEUTRAL, "평범")
        .when(total >= 45, "부정").when(total <= 10, "긍정").when(risk >= 25, "부정").when(risk <= 10, "긍정").otherwise("평범")
    )


def valence(gt: Column, crisis: Column, total: Column, harm: Column, happy: Column, worry: Column, abuse_q: Column, mood_q: Column, life_q: Column, urgent_q: Column, peers_q: Column, future: Column,
            high: int = 45, low: int = 10, risk_high: int = 25, risk_low: int = 10) -> Column:
    """부정, 평범 or 긍정 from a record's scalars, by an ordered decision list."""
    risk = mood_q + life_q + abuse_q + urgent_q
    guard = F.when(peers_q <= 2, 1).otherwise(0) + F.when(future == 0, 1).otherwise(0)
    base = F.when(crisis.isin(CRISIS_NEGATIVE), "부정").when(crisis == CRISIS_POSITIVE, "긍정").when(crisis == CRISIS_NEUTRAL, "평범")
    base = F.when(total >= high, "부정").when(base.isNull() & (total <= low), "긍정").otherwise(base)
    unsure = F.when((risk >= risk_high) & (guard == 0), "부정").when((risk <= risk_low) & (guard >= 1), "긍정").otherwise("평범")
    bright = F.when((risk >= risk_high + 10) & (guard == 0), "부정").when(risk >= risk_high, "평범").otherwise("긍정")
    plain = F.when((risk >= risk_high) & (guard == 0), "부정").when((risk <= risk_low) & (guard >= 2), "긍정").otherwise("평범")
    calm = (happy == 0) & (worry == 0) & (abuse_q == 0) & (crisis.isNull() | crisis.isin(CRISIS_POSITIVE, CRISIS_NEUTRAL))
    return (
        F.when(gt.isNotNull(), "부정").when(harm > 0, "부정").when(happy >= 7, "부정").when(calm, "긍정")
        .when(base.isNull(), unsure).when(base == "긍정", bright).when(base == "평범", plain).otherwise("부정")
    )


def record_valence(info: Column, items: Column, gt: Column) -> Column:
    """``valence`` of a record."""
    return valence(
        gt, info["위기단계"], F.trim(info["합계점수"]).try_cast("int"), item_max(items, "자해/자살"), item_max(items, "행복"), item_max(items, "걱정"),
        question_sum(items, "학대여부"), question_sum(items, "기분문제"), question_sum(items, "기본생활"), question_sum(items, "응급"), question_sum(items, "대인관계"), item_max(items, "미래/진로"),
    )


def record_simple_valence(info: Column, items: Column) -> Column:
    """``simple_valence`` of a record."""
    return simple_valence(
        info["위기단계"], F.trim(info["합계점수"]).try_cast("int"), item_max(items, "자해/자살"), item_max(items, "행복"), item_max(items, "걱정"),
        question_sum(items, "학대여부"), question_sum(items, "기분문제"), question_sum(items, "기본생활"), question_sum(items, "응급"),
    )


def best_class(scores: Column, above: Column | int) -> Column:
    """The class with the largest score above a bound; ties to the more severe."""
    named = F.filter(F.arrays_zip(_classes().alias("c"), scores.alias("s")), lambda x: x["s"] > above)
    top = F.array_max(F.transform(named, lambda x: x["s"]))
    return F.get(F.filter(named, lambda x: x["s"] == top)["c"], F.lit(0))


def main_sub(gt: Column | None, scores: Column, clinical: Column, theta: int = MAIN_THRESHOLD, tau: int = SUB_THRESHOLD, use_clinical: bool = True, compat: bool = True) -> Column:
    """struct<main, subs>: the leading class and the others that count, by severity.

    ``gt`` (or null) decides first, then the scores above ``theta``, then a class that the clinical text names, then
    the best secondary class.  With ``compat`` a class that is already secondary stays so when the text makes it main.
    """
    by_score = best_class(scores, theta)
    first = by_score if gt is None else F.coalesce(gt, by_score)
    high = F.filter(F.arrays_zip(_classes().alias("c"), scores.alias("s")), lambda x: x["s"] >= tau)["c"]
    subs = F.filter(high, lambda c: ~F.coalesce(c == first, F.lit(False)))
    named = F.filter(_classes(), lambda c: F.contains(F.coalesce(clinical, F.lit("")), c)) if use_clinical else F.array().cast("array<string>")
    main = F.coalesce(first, F.get(named, F.lit(0)))
    more = F.filter(named, lambda c: ~F.coalesce(c == main, F.lit(False)))
    all_subs = F.array_union(subs if compat else F.filter(subs, lambda c: ~F.coalesce(c == main, F.lit(False))), more)
    promoted = F.get(F.filter(F.array_sort(F.transform(F.filter(F.arrays_zip(_classes().alias("c"), scores.alias("s")), lambda x: F.array_contains(all_subs, x["c"])),
                                                        lambda x: F.struct((-x["s"]).alias("k"), F.array_position(_classes(), x["c"]).alias("r"), x["c"].alias("c")))), lambda x: x["c"].isNotNull())["c"], F.lit(0))
    final = F.coalesce(main, promoted)
    rest = F.when(main.isNull(), F.filter(all_subs, lambda c: ~F.coalesce(c == final, F.lit(False)))).otherwise(all_subs)
    return F.struct(final.alias("main"), F.when(final.isNull(), F.array().cast("array<string>")).otherwise(by_rank(rest, ABUSE_ORDER)).alias("subs"))


def normalise_label(label: Column) -> Column:
    """A ground-truth label in its standard form."""
    canon = F.create_map(*(F.lit(x) for kv in GT_CANON.items() for x in kv))
    s = F.regexp_replace(label, r"\s+", "")
    s = F.coalesce(F.element_at(canon, s), s)
    s = F.when(s.endswith("적학대"), F.replace(s, F.lit("적학대"), F.lit("학대"))).otherwise(s)
    return F.coalesce(F.element_at(canon, s), s)


def gt_labels(text: Column, known_only: bool = True) -> Column:
    """The set of ground-truth classes that a flattened field names, sorted by severity; others last, if wanted."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    found = F.transform(F.regexp_extract_all(s, F.lit("([가-힣]+?)학대"), F.lit(1)), lambda m: normalise_label(F.concat(m, F.lit("학대"))))
    neglect = F.when(s.contains("방임") | s.contains("유기"), F.array(F.lit("방임"))).otherwise(F.array().cast("array<string>"))
    named = F.filter(_classes(), lambda c: F.contains(s, c))
    every = F.array_union(F.array_union(found, neglect), named)
    return by_rank(F.array_intersect(every, _classes()) if known_only else every, ABUSE_ORDER)


def gt_main(text: Column) -> Column:
    """The most severe known class, or null."""
    return F.get(gt_labels(text), F.lit(0))


def gt_status(text: Column) -> Column:
    """mapped, missing or unmappable."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") == ""
    return F.when(blank, "missing").when(F.size(gt_labels(text)) > 0, "mapped").otherwise("unmappable")


def flatten_variant(v: Column) -> Column:
    """A polymorphic field as text: strings as they are, lists joined by a space, objects by their val, text or value (two levels)."""
    def one(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        pick = F.coalesce(*(F.try_variant_get(x, f"$.{k}", "string") for k in ("val", "text", "value")), F.to_json(x))
        return F.when(kind.startswith("OBJECT"), pick).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))

    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(items, " ")).otherwise(one(v))


def case_tier(scores: Column) -> Column:
    top, total = F.array_max(scores), F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    return F.when(top > MAIN_THRESHOLD, "CLEAR").when(total > 0, "BORDERLINE").otherwise("ZERO")


def main_source(main: Column, scores: Column, keywords: Column, theta: int = MAIN_THRESHOLD, tau: int = SUB_THRESHOLD, use_clinical: bool = True) -> Column:
    """none, score, clinical, fallback_sub or unknown."""
    s = F.get(F.filter(F.arrays_zip(_classes().alias("c"), scores.alias("s")), lambda x: x["c"] == main)["s"], F.lit(0))
    return F.when(main.isNull(), "none").when(s > theta, "score").when(F.lit(use_clinical) & F.array_contains(keywords, main), "clinical").when(s >= tau, "fallback_sub").otherwise("unknown")


def mismatch_reason(gt: Column, main: Column, subs: Column, main_without: Column, source: Column, gt_top: Column, top: Column, n_keywords: Column, theta: int = MAIN_THRESHOLD, tau: int = SUB_THRESHOLD) -> Column:
    """struct<reason, cause>: why the main label is outside the ground-truth set, by an ordered cascade.

    ``main_without`` is the main label without the clinical text; ``gt_top`` and ``top`` are the largest scores of
    ground-truth classes and of all.
    """
    r = lambda reason, cause: F.struct(F.lit(reason).alias("reason"), F.lit(cause).alias("cause"))
    inside = lambda c: F.coalesce(F.array_contains(gt, c), F.lit(False))
    in_sub = F.arrays_overlap(gt, subs)
    return (
        F.when(main.isNull(), r("no_algorithm_main", "score"))
        .when(inside(main), r("main_match", "match"))
        .when(~main.eqNullSafe(main_without) & inside(main_without), r("clinical_override_from_gt", "clinical"))
        .when((source == "clinical") & in_sub, r("clinical_main_with_gt_in_sub", "clinical"))
        .when(source == "clinical", r("clinical_main_not_in_gt", "clinical"))
        .when(in_sub, r("score_priority_gt_in_sub", "score"))
        .when(gt_top < tau, r("gt_below_sub_threshold", "score"))
        .when((gt_top <= theta) & (top > theta), r("gt_not_top_over_main_threshold", "score"))
        .when((top <= theta) & (n_keywords == 0), r("no_score_or_clinical_signal", "score"))
        .otherwise(r("other_mismatch", "mixed"))
    )


def doc_id_normal(c: Column) -> Column:
    """Numeric ids without leading zeros and decimal zeros; others trimmed."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d+(\.0+)?$"), F.regexp_extract(t, r"^0*(\d+?)(?:\.0+)?$", 1)).otherwise(t)
