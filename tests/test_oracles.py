"""Every registered query that has a SQL twin, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyloom import plans

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = plans.catalog()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


#: Minutes each; run with fewer samples or folds below.
SLOW = {"tfidf_cv_lr", "ovr_probs", "bridge_rerank", "instability_flags", "nested_recovery", "confirm"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_slow_queries_run_in_small(spark, monkeypatch):
    """The same plans with two folds, few samples and unigrams."""
    from tallyloom.plans import models

    def fewer(module, name, **least):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **kw: f(*a, **(kw | least)))

    fewer(models.ml, "cross_validate", k=2)
    fewer(models.ml, "binary_relevance", k=2)
    fewer(models.ml, "tfidf", bigrams=False, max_features=50)
    fewer(models.oversight, "instability", seeds=(1,), k=2, n_boot=3, bigrams=False)
    fewer(models.nested, "scored_rows", k=5, inner=3, bigrams=False, min_df=8)
    fewer(models.resample, "bridge_null", n=20)
    fewer(models.resample, "bridge_bootstrap", n=10)
    for name in sorted(SLOW):
        out = QUERIES[name](spark, DATA)
        rows = out.collect()
        assert rows or name == "confirm", name
        if name == "bridge_rerank":
            assert out.columns == ["doc_id", "pred"] and any("|" in r.pred for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["word", "primary", "secondary", "p1", "p2", "gap"]
    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[0]) >= len(QUERIES)
