"""Terms of training folds, counted together, against plain counts of each training set."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import foldterms, ml
from tallyloom.sources.scratch import written


def plain(train, min_df, most, bigrams):
    """term (a word or a pair): 1 + idf of one training set."""
    df, tf = Counter(), Counter()
    for words in train:
        c = Counter(terms(words, bigrams))
        df.update(c.keys())
        tf.update(c)
    least = min_df if max(df.values(), default=0) >= min_df else 1
    known = sorted((t for t in df if df[t] >= least), key=lambda t: (-tf[t], len(t), t))[:most]
    return {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in known}


def terms(words, bigrams):
    words = words or []
    return [(w,) for w in words] + (list(zip(words, words[1:])) if bigrams else [])


@pytest.mark.parametrize("min_df, most, bigrams", [(2, 25, True), (2, 1000, True), (1, 1000, True), (90, 40, True), (2, 12, False)])
def test_fold_terms_are_those_of_each_training_set(spark, min_df, most, bigrams):
    rng = random.Random(most)
    rows = [(i, i * 7 % 3, [f"w{int(rng.expovariate(0.15))}" for _ in range(rng.randint(0, 30))]) for i in range(60)] + [(100, 0, None), (101, 1, ["w0"] * 40)]
    d = written(spark.createDataFrame(rows, "doc_id int, fold int, toks array<string>").repartition(5))
    got = ml.tfidf(min_df=min_df, max_features=most, bigrams=bigrams).by_fold(d, 3)
    for f in range(3):
        want = plain([w for _, g, w in rows if g != f], min_df, most, bigrams)
        have = {tuple(t.split(" ")): x for t, x in zip(got.terms, got.idf[f], strict=True) if x}
        assert have.keys() == want.keys() and all(abs(have[t] - x) < 1e-12 for t, x in want.items())
        made = {r.doc_id: r.features.toArray() for r in got.features(f).transform(got.rows).collect()}
        assert len(made) == len(rows)
        for i, _, words in rows:
            raw = {t: k * want[t] for t, k in Counter(terms(words, bigrams)).items() if t in want}
            size = math.sqrt(sum(x * x for x in raw.values())) or 1
            assert np.allclose(made[i], [raw.get(tuple(t.split(" ")), 0) / size for t in got.terms], atol=1e-12)


def test_fold_terms_of_long_rows_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(foldterms, "PIECE", 4)
    d = written(spark.createDataFrame([(i, i % 2, ["a", "b"] * (i % 3 * 3)) for i in range(9)], "doc_id int, fold int, toks array<string>").coalesce(1))
    assert {"a", "b", "a b", "b a"} == set(foldterms.fold_terms(d, "toks", 2).terms)
    none = written(spark.createDataFrame([(1, 0, []), (2, 1, None)], "doc_id int, fold int, toks array<string>"))
    got = foldterms.fold_terms(none, "toks", 2)
    assert got.terms == [] and got.features(0).transform(got.rows).count() == 2


def test_ascii_words_are_cleaned_tokens(spark):
    odd = [None, "", " ", "a", "ab c dEİx KK 12-3", " x yz\x0b\x1cqq\n\nr2", "ßSS ﬁx \U0001d538ab", "__ab__9"]
    t = spark.createDataFrame([(x,) for x in odd], "t string").select(tx.ascii_words(F.col("t")).alias("a"), tx.tokens(tx.clean(F.col("t"), tx.ASCII), []).alias("b"))
    assert all(r.a == r.b for r in t.collect())
