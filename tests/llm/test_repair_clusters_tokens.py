"""Conversation repair, centroid clustering and token counts against plain code, and on odd rows."""

import hashlib
import math
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"
#: The agreed columns of each query and their types (fixed values).
COLUMNS = {
    "op11_conversation_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op12_centroid_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    from tallyloom.llm import registry

    assert dict(registry.QUERIES[name](spark, DATA).dtypes) == COLUMNS[name]


def saved(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# 11
TURNS = "conv_id long, turn long, role string, text string"


def plain_repairs(rows):
    """{conv_id: the query's other columns}."""
    found = {}
    for c, t, role, text in rows:
        found.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault:
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            found[c] += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for c, v in found.items():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        turns = [x[0] for x in v if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        *rest, text = brute.repair(v) if v else (0, 0, 0, 0, 0, "", "")
        out[c] = (gaps, *rest, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(8)
    rows = [(None, None, None, None), (None, None, None, None), (None, 3, "user", "Well."), (1, None, "user", None), (1, None, "", "Text"), (2, 5, "User", "No. Yes?  \n"), (2, 9, "tool", "out\x0b")]
    rows += [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 1, "assistant", "Same."), (3, 1, "assistant", "Other!")]
    rows += [(4, 2, "user", "word " * 300_000 + "end."), (4, 3, "assistant", "…"), (5, 1, "assistant", ""), (6, 1, "user", " \t\r\n")]
    for c in range(10, 60):
        rows += [(c, rng.choice([None, *range(12)]), rng.choice(["system", "user", "user", "assistant", "assistant", "x"]), rng.choice(["Yes.", "No!", "Why?", "cut", "", "A longer one. And", "A: b."])) for _ in range(rng.randint(1, 7))]
    return rows


def test_repair_query_matches_plain_code(spark, tmp_path):
    from tallyloom.llm import conversation_repair

    rows = odd_conversations()
    d = spark.createDataFrame(rows, TURNS)
    for c in ("at", "code", "part", "fault", "audit", "digest", "_row", "copy"):
        d = d.withColumn(c, F.lit("x"))
    folder = saved(d, tmp_path, "conversations")
    want = plain_repairs(rows)
    assert {r[0]: tuple(r)[1:] for r in conversation_repair.op11_conversation_repair(spark, folder).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(conversation_repair.OP11_SQL).fetchall()} == want


def test_repair_in_segments(spark, monkeypatch):
    """Segments of four turns give what one pass gives, texts included."""
    from tallyloom.llm import conversation_repair as cr

    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant"]), f"{rng.choice(['a', 'b', ''])}{rng.choice(['.', ''])}") for c in range(12) for t in range(rng.randint(1, 14))]
    d = spark.createDataFrame(rows, TURNS)
    results = []
    for bits in (2, 12):
        monkeypatch.setattr(cr, "SEGMENT_BITS", bits)
        verdicts, turns = cr.repair_conversations(cr.ordered_turns(d))
        texts = {}
        for r in turns.orderBy("conv_id", "at", "nth").collect():
            texts.setdefault(r.conv_id, []).append((r.edit, f"{r.role}:{r.text}"))
        results.append(({r.conv_id: (r.cost, r.audit) for r in verdicts.collect()}, texts))
    assert results[0] == results[1]
    for c in range(12):
        *_, cost, audit, text = brute.repair([r[1:] for r in rows if r[0] == c])
        assert results[0][0][c] == (cost, audit)
        assert "\n".join(x for _, x in results[0][1].get(c, [])) == text
        assert "".join(e for e, _ in results[0][1].get(c, [])) == audit.replace("D", "")


def test_repair_of_random_codes():
    from tallyloom.llm import conversation_repair as cr

    rng = random.Random(5)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "x", "1": "system", "2": "user", "3": "assistant", "0": "x"}
    for _ in range(1500):
        codes = "".join(rng.choice("suaoSUAO1230") for _ in range(rng.randint(1, 6)))
        rows = [(i, roles[c.lower()], "" if c.isdigit() else f"t{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(codes)]
        *_, illegal, cost, audit, _ = brute.repair(rows)
        cut = rng.randint(0, len(codes))
        assert cr.solve([cr.segment(codes)]) == cr.solve([cr.segment(x) for x in (codes[:cut], codes[cut:]) if x]) == (cost, audit)
        assert cr.illegal_pairs(codes) == illegal and len(cr.plans(audit, codes)) == len(codes)


def test_repair_of_one_very_long_conversation(spark):
    """A conversation over several segments: a row for each turn, nothing but the roles' order to mend."""
    from tallyloom.llm import conversation_repair as cr

    d = spark.range(20_001).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    verdicts, turns = cr.repair_conversations(cr.ordered_turns(d))
    (v,) = verdicts.collect()
    assert (v.gaps, v.blank, v.duplicate, v.truncated, v.illegal, v.cost, v.audit) == (0, 0, 0, 0, 0, 2, "K" * 20_001 + "I")
    digest = cr.running_sha256(turns, "conv_id", ["at", "nth"], F.concat("role", F.lit(":"), "text").cast("binary")).collect()
    text = "\n".join([f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}." for i in range(20_001)] + ["assistant:"])
    assert [tuple(r) for r in digest] == [(7, hashlib.sha256(text.encode()).hexdigest())]


def test_repair_of_nothing(spark, tmp_path):
    from tallyloom.llm import conversation_repair as cr

    assert cr.op11_conversation_repair(spark, saved(spark.createDataFrame([], TURNS), tmp_path, "conversations")).count() == 0


# 12
def plain_clusters(rows, k, rounds, seed, dimensions):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def odd_vectors(rng, n, dimensions):
    v = [[float(np.float32(x)) for x in rng.normal(size=dimensions)] for _ in range(n)]
    v += [v[0], v[0], v[1], [0.0] * dimensions, [0.0] * dimensions]
    rows = list(enumerate(v)) + [(3, v[5]), (None, v[6]), (None, v[7])]
    bad = [None, [], v[0][:-1], [*v[0], 1.0], [None, *v[0][1:]], [float("nan"), *v[0][1:]], [float("inf"), *v[0][1:]], [-float("inf"), *v[0][1:]]]
    return rows + [(900 + i, x) for i, x in enumerate(bad)]


@pytest.mark.parametrize("n,k,dimensions", [(300, 12, 5), (60, 40, 64), (4, 40, 3)])
def test_clusters_match_plain_code(spark, n, k, dimensions):
    from tallyloom.llm import clustering

    rows = odd_vectors(np.random.default_rng(n), n, dimensions)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("tree", F.lit("x"))
    got, centroids = clustering.cluster(d, k=k, dimensions=dimensions)
    want, expected = plain_clusters(rows, k, 5, 2, dimensions)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert centroids.tolist() == expected
    facts = clustering.with_inertia(got, centroids).collect()
    assert all(r.inertia == sum(x[2] for x in want) and r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster) for r in facts)


def test_cover_tree_invariants_and_bounds():
    from tallyloom.llm import clustering as cl

    rng = np.random.default_rng(6)
    middles = rng.integers(-4000, 4000, (12, 8))
    x = np.concatenate([middles[rng.integers(0, 12, 1500)] + rng.integers(-150, 150, (1500, 8)), np.repeat(middles[:1], 50, 0)])
    t = cl.cover_tree(x)
    assert sorted(t.order.tolist()) == list(range(len(x))) and (t.points == x[t.order]).all()
    for i in range(len(t.centre)):
        own = t.points[t.low[i] : t.high[i]] - t.points[t.centre[i]]
        assert abs(np.sqrt((own**2).sum(1)).max() - t.radius[i]) < 1e-6
        children = range(t.first[i], t.last[i])
        if children:
            assert t.low[children[0]] == t.low[i] and t.high[children[-1]] == t.high[i] and t.centre[children[0]] == t.centre[i]
            c = t.points[t.centre[children[0] : children[-1] + 1]].astype(float)
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert apart.min() > t.radius[i] / cl.SHRINK and t.radius[children[0] : children[-1] + 1].max() <= t.radius[i] / cl.SHRINK
    centroids = np.concatenate([middles, middles[:2]])
    seeds = cl.cover_tree(centroids, leaf=1)
    pairs, _ = cl.candidates(t, seeds)
    compared = ((t.high - t.low)[pairs[0]] * (seeds.high - seeds.low)[pairs[1]]).sum()
    assert compared < 0.3 * len(x) * len(centroids)  # bounds rule most pairs out
    label, best = cl.nearest(t, seeds, seeds.order)
    d = ((t.points[:, None] - centroids[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all() and (best == d.min(1)).all()


def test_clusters_of_nothing_and_of_large_numbers(spark):
    from tallyloom.llm import clustering as cl

    kind = "vec_id long, embedding array<float>"
    assert cl.with_inertia(*cl.cluster(spark.createDataFrame([], kind))).count() == 0
    big = [(i, [float(x)] * 64) for i, x in enumerate((-500_000, 500_000, 499_999))]
    got, _ = cl.cluster(spark.createDataFrame(big, kind), k=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_clusters(big, 2, 5, 2, 64)[0]
    with pytest.raises(Exception, match="beyond"):
        cl.cluster(spark.createDataFrame([(1, [1e30] * 64)], kind))


# 13
def library(path="word_bpe_49k.json"):
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(path))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_match_the_library(spark, name):
    from tallyloom.llm import bpe, token_counts

    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    signs = [*"abcXYZ'  \t\n\x1c\x850123²½éÉüßİıΣσςÅ漢한🙂👍🏽٣अﬁⅧⅷ_-—…", "é", "'ll ", "Don't", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "‍", "\U0002f800", "͸"]
    rows += [(10_000 + i, "".join(rng.choices(signs, k=rng.randint(0, 40)))) for i in range(400)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n\t"), (20_002, " \n\t"), (None, "Twice"), (None, "Twice"), (20_003, "word " * 250_000), (20_004, "x" * 1_200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("pieces", F.lit("x")).withColumn("block", F.lit("x"))
    shared = token_counts.share_tokenizer(spark, bpe.vocabulary_path(name))
    got = token_counts.token_counts(d, shared, block_bytes=100_000).collect()
    lib = library(name)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_plain_words_are_used_and_doubtful_characters_found():
    from tallyloom.llm import bpe, token_counts

    spec = open(bpe.vocabulary_path("word_bpe_49k.json"), encoding="utf-8").read()
    p = token_counts.PreTokenizer(spec)
    assert p.plain and "Σ" in p.odd and "́" in p.odd and not set("éñß字한Жא٣²") & set(p.odd)
    assert not token_counts.PreTokenizer(open(bpe.vocabulary_path("byte_bpe_50k.json"), encoding="utf-8").read()).plain


def test_token_counts_of_nothing(spark):
    from tallyloom.llm import bpe, token_counts

    shared = token_counts.share_tokenizer(spark, bpe.vocabulary_path("word_bpe_49k.json"))
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), shared).count() == 0
