"""The registered queries of the operators: columns, types and rows as agreed, over whole tables."""

import os
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"
#: The agreed columns of each query and their types (fixed values).
COLUMNS = {
    "op1_katz_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_repeated_bytes": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_minhash_groups": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}
REMAINDER = {"op1_katz_scores": (10, 0), "op6_language_id": (5, 0), "op8_toxicity": (3, 1)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    from tallyloom.llm import registry

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    out = registry.QUERIES[name](spark, DATA)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    if name in REMAINDER:
        modulus, rest = REMAINDER[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    if "score" in COLUMNS[name] and name != "op1_katz_scores":
        assert all(0 <= r.score <= 1 for r in got)
    if name == "op8_toxicity":
        assert all(r.predicted == int(r.score >= 0.7) for r in got)
    if name == "op9_repeated_bytes":
        text = {r.doc_id: (r.text or "").encode() for r in docs}
        assert all(r.n_bytes == len(text[r.doc_id]) and 0 <= r.n_removed <= r.n_bytes and (r.n_spans == 0) == (r.n_removed == 0) for r in got)
    if name == "op10_minhash_groups":
        assert all(r.component_id <= r.doc_id and r.kept == (r.component_id == r.doc_id) for r in got)


def test_operators_on_texts_over_a_mebibyte(spark):
    """Word runs longer than a piece, without and with repeats, beside short rows."""
    from tallyloom.llm import bpe, exact_dedup, katz, near_dedup

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=230_000))
    assert len(long) > 1 << 20
    cut = long.split(" ")
    cut[100] = cut[200_000] = "changed"
    rows = [(1, long), (2, " ".join(cut)), (3, long.replace(" ", "\n")), (4, "short one here now"), (5, "x" * (1 << 21))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size=4).collect()} == brute.near_groups(rows, 4)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, hash_all=True).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1), 5: (5, 1)}
    model = brute.Katz([t for _, t in rows])
    for r in katz.katz_scores(docs, F.lit(False)).collect():
        n, known, base, score = model.score(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known) and abs(r.base_score / base - 1) < 1e-9 and abs(r.score / score - 1) < 1e-9
    shared = bpe.share_vocabulary(spark, bpe.vocabulary_path())
    assert {r.doc_id: r.decoded for r in bpe.bpe_encode(docs, shared, decode=True).collect()} == dict(rows)
