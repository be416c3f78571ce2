"""Near-duplicate groups with min-max hashing.

A document is the set of its distinct word shingles.  Under each of ``PERMUTATIONS`` permutations of the shingle
hashes both the minimum and the maximum are kept, so that 64 hash evaluations give 128 values; each agrees
between two documents with the probability of their Jaccard similarity.  The values are cut into bands of five;
two sets of similarity 0.8 miss all 25 bands with a probability of 5e-5, of 0.85 with 4e-7.  Documents with a common
band are candidates, and a link is confirmed on the full sets, in whole numbers.

Copies are one node: what follows sees distinct sets only.  Within a bucket not all pairs are emitted.  First
every node is compared with one centre, the smallest node among its buckets.  Buckets that still hold more than
one component are open, and are refined one by one; of open buckets with the same members one is.  A bucket's
largest component needs no comparison within itself: its nodes meet the bucket's other nodes alone, and those of a
size that none of the others can match stay away.  Nodes meet in blocks of about ``BLOCK`` nodes and
``BLOCK_BYTES``, two blocks a task, where a product of their presence matrices counts all intersections at once; of
the nodes that they link, each comes out once, with the first of them.  What remains uncompared is connected already, so
the components are those of all candidates.

Nodes, pairs and components stay tables.  Sets travel once for each comparison, of candidates only, and are made
from one row of each node.

Defined cases: a null or empty text has an empty set and is linked with nothing; repeated rows are copies of one
another; a null id is ignored for the smallest id of a component, which is null if all ids are; an empty table
gives an empty result; extra columns are ignored; long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, discard, materialize, new_name, partitions, read_table, text_or_empty
from tallyloom.llm.components import connected_components
from tallyloom.llm.words import each_text_words, mix, random_values, shingles

PERMUTATIONS, BAND = 64, 5
#: Nodes of a block and bytes of their sets, about; shingles that one matrix product covers.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 4096
_U = np.uint64
_MULTIPLIERS = random_values(PERMUTATIONS, 301) | _U(1)
_OFFSETS = random_values(PERMUTATIONS, 302)


def min_max(hashes: np.ndarray) -> np.ndarray:
    """For each permutation the minimum and the maximum: 2 * PERMUTATIONS values."""
    low, high = np.full(PERMUTATIONS, ~_U(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 8192):
        h = hashes[None, at : at + 8192] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]
        low, high = np.minimum(low, h.min(1)), np.maximum(high, h.max(1))
    return np.stack([low, high], 1).ravel()


def bands(hashes: np.ndarray) -> np.ndarray:
    """One bucket number for each band; it depends on the band's place too."""
    v = min_max(hashes)
    v = v[: len(v) // BAND * BAND].reshape(-1, BAND)
    h = np.arange(1, len(v) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for k in range(BAND):
        h = mix(h ^ v[:, k])
    return h.view(np.int64)


def _fingerprint(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (fingerprint of the set), bands; null node and bands for an empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets = [shingles(w, size) for w in each_text_words(b.column(2))]
            nodes = [_fingerprint(s) if len(s) else None for s in sets]
            cut = [bands(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(cut, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "node", "bands"],
            )

    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return d.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (packed sorted hashes) of the texts named in ``wanted`` (text_hash, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets = [s for s in (shingles(w, size) for w in each_text_words(b.column(0))) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    one = (texts["text_hash"] == wanted["text_hash"]) & texts["id"].eqNullSafe(wanted["doc_id"])
    picked = texts.join(wanted.hint("shuffle_hash"), one, "left_semi").select("text")
    return picked.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, np.zeros(0, np.uint64)
        for b in blocks(batches, column="x"):
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                left = np.frombuffer(x.as_buffer(), np.uint64)
                if last is None or not last.equals(y):
                    last, right = y, np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                    good.append(False)
                    continue
                at = np.searchsorted(right, left)
                at[at == len(right)] = 0
                common = int((right[at] == left).sum())
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    of_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = of_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, label, n of the buckets with several components; of buckets with equal members one."""
    named = members.select("bucket", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    name = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(20,0)"))
    of_bucket = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), name(1).alias("x"), name(2).alias("y"))
    mixed = of_bucket.where("low != high").groupBy("x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return materialize(named.join(mixed, "bucket", "left_semi"), compact=True)


def _block_links(rows: list[tuple[bytes, bytes, bytes, int]], pair: tuple[int, int], percent: int) -> tuple[list[bytes], list[bytes]]:
    """Links between different labels, of one block or of two with each other: rows of node, label, set, block.

    Of the nodes that links connect, each comes out linked with the first; the other links follow from these.
    """
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    shared = counts[inverse] > 1
    column = np.cumsum(counts > 1)[inverse[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(rows), len(rows)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        x, y = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(rows), min(COLUMNS, width - at)), np.float32)
        m[owner[x:y], column[x:y] - at] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    _, label = np.unique([r[1] for r in rows], return_inverse=True)
    block = np.array([r[3] for r in rows])
    good = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (label[:, None] != label[None, :])
    if pair[0] != pair[1]:
        good &= block[:, None] != block[None, :]
    first = np.arange(len(rows))
    while True:
        lowest = np.minimum(first, np.where(good, first[None, :], len(rows)).min(1))
        if (lowest == first).all():
            break
        first = lowest
    b = np.flatnonzero(first != np.arange(len(rows)))
    return [rows[i][0] for i in first[b]], [rows[i][0] for i in b]


def _bucket_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar enough within the open buckets.

    Blocks below 0 hold a bucket's largest component, the others the rest of its nodes.
    """
    spark = open_.sparkSession
    by_label = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = by_label.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("m")).select("bucket", F.col("m.label").alias("major"))
    sided = open_.join(largest, "bucket").withColumn("of_major", F.col("label") == F.col("major"))
    minor, major = ~F.col("of_major"), F.col("of_major")
    count = lambda side: F.ceil(F.greatest(F.sum(side.cast("long")) / BLOCK, F.sum(F.when(side, F.col("n")).otherwise(0)) * 8 / BLOCK_BYTES)).cast("int")
    sized = sided.groupBy("bucket").agg(count(major).alias("majors"), count(minor).alias("minors"), F.min(F.when(minor, F.col("n"))).alias("least"), F.max(F.when(minor, F.col("n"))).alias("most"))
    near = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    placed = sided.join(sized, "bucket").where(minor | near)
    h = F.xxhash64("node")
    placed = placed.withColumn("block", F.when(major, -1 - F.pmod(h, F.col("majors"))).otherwise(F.pmod(h, F.col("minors"))).cast("int"))
    others = F.when(major, F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(-F.col("majors"), F.col("minors") - 1))
    dealt = placed.withColumn("other", F.explode(others))
    dealt = dealt.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "label", "block").join(sets, "node")
    dealt = dealt.select("bucket", "x", "y", "node", "label", "shingles", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links() -> pa.RecordBatch:
            a, b = _block_links(rows, key[1:], percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for bucket, x, y, node, label, shingled, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, x, y) != key:
                    if len(rows) > 1:
                        yield links()
                    key, rows = (bucket, x, y), []
                rows.append((node, label, shingled, block))
        if len(rows) > 1:
            yield links()

    dealt = dealt.repartition(partitions(spark), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its component), kept, node."""
    rows = materialize(signatures(docs, size, id_col, text_col))
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("min_id"), one, F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    nodes = materialize(nodes.select("node", "min_id", "bands", "n", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash")))
    of_bucket = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = of_bucket.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(of_bucket.join(buckets.select("bucket", "centre"), "bucket"))

    met = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(shingle_sets(docs, met.select("text_hash", "doc_id"), size, id_col, text_col), "uncompressed")
    first = members.groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b")).where("a != b")
    links = materialize(confirm(first, sets, percent), compact=True)
    labels = connected_components(links)

    open_ = _open_buckets(members, labels)
    if not open_.isEmpty():
        more = materialize(_bucket_links(open_, sets, percent), compact=True)
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more))
    discard(members, sets, open_)

    grouped = nodes.join(labels, "node", "left").select("node", "min_id", F.coalesce("label", "node").alias("label"))
    lowest = grouped.groupBy("label").agg(F.min("min_id").alias("component_id"))
    by_node = materialize(grouped.join(lowest, "label").select("node", "component_id"))
    discard(nodes)
    found = rows.drop("bands").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "node", "text_hash")


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with one document of each group, that of the smallest id, and all their columns.

    Of repeated rows one stays.
    """
    found = near_duplicates(docs, size, percent, id_col, text_col)
    kept = materialize(found.where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")))
    mark = new_name(docs, "hash")
    texts = docs.withColumn(mark, F.xxhash64(text_or_empty(text_col)))
    out = texts.join(kept, texts[id_col].eqNullSafe(kept["doc_id"]) & (texts[mark] == kept["text_hash"]), "left_semi")
    if not kept.where("copies > 1").isEmpty():
        out = out.dropDuplicates([id_col, mark])
    return out.drop(mark)


def op10_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4).drop("node", "text_hash")
