"""The pipeline's stages against plain code, and the queries that have SQL against DuckDB."""

import collections
import os
import re
import sys

import duckdb
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


def plain_pipeline(rows, items, languages, codec):
    """{doc_id: (text, ids)} of what must be left; ``languages``: the first stage's verdicts."""
    from tallyloom.llm import line_dedup
    from tallyloom.llm.decontaminate import normalise

    rows = [r for r in rows if languages[r["doc_id"]]]
    pages = collections.Counter(r["source"] for r in rows)
    on = collections.Counter((r["source"], x) for r in rows for x in {x.strip(" \t\n\x0b\f\r") for x in r["text"].split("\n")})
    texts = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not x.strip(" \t\n\x0b\f\r") or (n := on[r["source"], x.strip(" \t\n\x0b\f\r")]) < line_dedup.MIN_PAGES or n <= line_dedup.RATIO * pages[r["source"]]) for r in rows}
    groups = brute.near_groups(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [normalise(x) for x in items if x]
    texts = {i: t for i, t in texts.items() if not any(near(x, normalise(t)) for x in items)}
    return {i: (t, codec.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def near(item, text):
    e = int(0.08 * len(item))
    if item in text:
        return True
    n = e + 1
    parts = [item[k * len(item) // n : (k + 1) * len(item) // n] for k in range(n)]
    return any(p in text for p in parts) and brute.edit_occurrence(item, text) <= e


def test_pipeline(spark):
    import corpus_pipeline
    from tallyloom.llm import bpe

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "decontaminate", "bpe_tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, DATA).collect()}
    rows = [r.asDict() for r in docs.collect()]
    assert all((r["doc_id"] in kept) or not re.search(r"[^\W\d_]", r["text"] or "") for r in rows)
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = plain_pipeline(rows, items, {r["doc_id"]: r["doc_id"] in kept for r in rows}, Tokenizer.from_file(bpe.vocabulary_path()))
    got = {r.doc_id: (r.text, list(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Some words here", "en", None, 15), (3, "Some words here", "en", None, 15), (None, "Other text entirely", None, "s", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name
        assert stage(spark, docs.where("false"), DATA).count() == 0
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 2


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_site_line_dedup", "op11_conversation_repair", "op12_centroid_clusters"])
def test_sql_twins(spark, name):
    from tallyloom.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    key = list(want.columns)[0]
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str))


def test_every_operator_is_registered():
    from tallyloom.llm import registry

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
