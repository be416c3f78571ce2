"""Centroid clustering by dual-tree Lloyd rounds in exact integers.

Vectors become integers (floor of ``SCALE`` times each component).  They are cut into blocks of ``BLOCK`` vectors where they
are read, without a shuffle; a block gets one cover tree, kept in a table for all rounds.  In each round a cover
tree over the centroids is built, and pairs of a vector node and a centroid node are walked down together: a pair goes
when its least possible distance exceeds what some centroid is sure to reach for every vector of the node.  Pairs of
leaves that are left are compared exactly.  A round gives each cluster's count and integer sums, added up within a
task first, so that only clusters times components meet and come to the driver; the new centroids are floors of exact
quotients there.

A cover tree's node stands for a range of its block's vectors around one of them, its centre.  Children's centres are the node's own centre
and vectors further than its radius / ``SHRINK`` from every one before (separation); each vector belongs to a child whose
centre is within that (covering).  Nodes of ``LEAF`` vectors or without extent are leaves.

Defined cases: null vectors and those with another number of components, or with a null, NaN or infinite one, are left out; a null id is
an id of its own (an empty string in the hash); repeated ids are vectors of their own, and among equal hashes the
smaller vector starts first; with fewer vectors than ``k`` each is a centroid; equal distances go to the smaller number;
an empty cluster keeps its centroid; an empty table gives an empty result; extra columns are ignored.  Components beyond
2 ** 27 after scaling raise an error, since a squared distance may not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize, read_table
from tallyloom.llm.packing import pack, unpack

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
BLOCK, LEAF, SHRINK = 4096, 16, 1.5
LIMIT = 1 << 27
#: Up to here sums of squared differences are whole numbers in double precision.
EXACT_DOUBLE = 1 << 22


@dataclass
class Tree:
    """Nodes in levels: centre (a place in the points), the range of points, the radius, and the range of children (empty for leaves)."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.centre, self.low, self.high, self.radius, self.first, self.last


def lengths(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", a, a))


def cover_tree(points: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> Tree:
    """The cover tree of integer points, breadth first; ``order`` says where each of the tree's points stood."""
    x = points.astype(np.float64)
    far = lengths(x - x[0])
    queue = [(np.arange(len(x)), far, 0)]  # members (the centre first), their distances from it, place of the first
    order = np.arange(len(x))
    centre, low, high, radius, first, last = [], [], [], [], [], []
    at = 0
    while at < len(queue):
        members, far, place = queue[at]
        r = float(far.max())
        centre.append(place)
        low.append(place)
        high.append(place + len(members))
        radius.append(r)
        first.append(len(queue))
        order[place : place + len(members)] = members
        if len(members) > leaf and r > 0:
            rest, distances = np.arange(len(members)), far
            while len(rest):
                near = distances <= r / shrink
                queue.append((members[rest[near]], distances[near], place))
                place += int(near.sum())
                rest = rest[~near]
                if len(rest):
                    distances = lengths(x[members[rest]] - x[members[rest[0]]])
        last.append(len(queue))
        queue[at] = None
        at += 1
    ints = (np.array(a, np.int64) for a in (centre, low, high, first, last))
    c, lo, hi, f, e = ints
    return Tree(points[order], order, c, lo, hi, np.array(radius), f, e)


def expand(pairs: np.ndarray, tree: Tree, side: int) -> np.ndarray:
    """The pairs with each node of one side replaced by its children; leaves stay."""
    node = pairs[side]
    n = tree.last[node] - tree.first[node]
    again = np.maximum(n, 1)
    out = np.repeat(pairs, again, axis=1)
    step = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    children = np.repeat(tree.first[node], again) + step
    out[side] = np.where(np.repeat(n, again) > 0, children, out[side])
    return out


def node_distances(a: Tree, b: Tree, pairs: np.ndarray, width: int = 1 << 16) -> np.ndarray:
    out = np.empty(pairs.shape[1])
    for at in range(0, len(out), width):
        p, q = pairs[:, at : at + width]
        out[at : at + width] = lengths(a.points[a.centre[p]].astype(np.float64) - b.points[b.centre[q]])
    return out


def candidates(vectors: Tree, centroids: Tree) -> tuple[np.ndarray, int]:
    """Leaf pairs that no distance bound rules out, and how many node pairs were looked at."""
    pairs, looked = np.zeros((2, 1), np.int64), 0
    reach = np.full(len(vectors.centre), np.inf)  # a distance within which each vector of the node has a centroid
    while True:
        apart = node_distances(vectors, centroids, pairs)
        looked += len(apart)
        sure = apart + vectors.radius[pairs[0]]
        np.minimum.at(reach, pairs[0], sure)
        least = apart - vectors.radius[pairs[0]] - centroids.radius[pairs[1]]
        pairs = pairs[:, least <= reach[pairs[0]] * (1 + 1e-9) + 1e-6]
        open_v = vectors.last[pairs[0]] > vectors.first[pairs[0]]
        open_c = centroids.last[pairs[1]] > centroids.first[pairs[1]]
        if not (open_v.any() or open_c.any()):
            return pairs, looked
        below = expand(np.stack([np.arange(len(reach)), np.arange(len(reach))]), vectors, 0)  # children know their parent's reach
        reach[below[0]] = np.minimum(reach[below[0]], reach[below[1]])
        pairs = expand(expand(pairs, vectors, 0), centroids, 1)


def nearest(vectors: Tree, centroids: Tree, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the tree's vectors the number of its nearest centroid (the smaller of equals) and the squared distance."""
    pairs, _ = candidates(vectors, centroids)
    x, c = vectors.points, centroids.points
    if max(np.abs(x).max(), np.abs(c).max()) <= EXACT_DOUBLE:
        x, c = x.astype(np.float64), c.astype(np.float64)
    best, label = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    xx = np.einsum("ij,ij->i", x, x)
    by_leaf = pairs[:, np.argsort(pairs[1], kind="stable")]
    for node in np.unique(by_leaf[1]):
        leaves = by_leaf[0][np.searchsorted(by_leaf[1], node) : np.searchsorted(by_leaf[1], node, "right")]
        size = vectors.high[leaves] - vectors.low[leaves]
        rows = np.repeat(vectors.low[leaves] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for j in range(centroids.low[node], centroids.high[node]):
            d = (xx[rows] - 2 * (x[rows] @ c[j]) + c[j] @ c[j]).astype(np.int64)
            closer = (d < best[rows]) | ((d == best[rows]) & (numbers[j] < label[rows]))
            best[rows[closer]], label[rows[closer]] = d[closer], numbers[j]
    return label, best


def whole_numbers(flat: np.ndarray, dimensions: int, scale: int) -> np.ndarray:
    scaled = np.floor(scale * flat.astype(np.float64))
    if len(scaled) and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"a component beyond {LIMIT} after scaling")
    return scaled.astype(np.int64).reshape(-1, dimensions)


def usable(rows: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """vec_id and the vector of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where((F.size("vector") == dimensions) & finite)


def plant_trees(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """A written table of blocks: vec_ids in the tree's order, and the packed tree."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def rows_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = whole_numbers(t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), dimensions, scale)
        tree = cover_tree(x)
        ids = t.column("vec_id").combine_chunks().take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([pack(tree.points.ravel(), *tree.parts())], pa.binary())], ["vec_ids", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, block - n))
                b, n = b.slice(block - n), n + held[-1].num_rows
                if n == block:
                    yield rows_of(held)
                    held, n = [], 0
        if held:
            yield rows_of(held)

    return materialize(vectors.mapInArrow(run, f"vec_ids array<{kind}>, tree binary"))


def _tree(packed: bytes, dimensions: int) -> Tree:
    points, *parts = unpack(packed)
    points = points.reshape(-1, dimensions)
    return Tree(points, np.arange(len(points)), *parts)


def _labels(blob: pa.Scalar, centroids: np.ndarray, seeds: Tree) -> tuple[Tree, np.ndarray, np.ndarray]:
    vectors = _tree(blob.as_py(), centroids.shape[1])
    return vectors, *nearest(vectors, seeds, seeds.order)


def lloyd_round(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, seeds = np.zeros((k, width), np.int64), np.zeros(k, np.int64), cover_tree(centroids, leaf=1)
        for b in batches:
            for blob in b.column(0):
                vectors, label, _ = _labels(blob, centroids, seeds)
                np.add.at(sums, label, vectors.points)
                counts += np.bincount(label, minlength=k)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(counts[hit], pa.int64()), pa.array(sums[hit].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    part = trees.select("tree").mapInArrow(run, "cluster long, n long, sums array<long>")
    added = part.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in added.collect():  # clusters times components
        out[r.cluster, r.place] = int(r.s) // int(r.n)
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int, dimensions: int, scale: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the hashes' order."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = vectors.select(sha.alias("sha"), "vector").orderBy("sha", "vector").limit(k).collect()
    return whole_numbers(np.array([r.vector for r in chosen], np.float64).ravel(), dimensions, scale)


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(a written table of vec_id, cluster and squared distance; the centroids)."""
    vectors = usable(rows, id_col, vector_col, dimensions)
    kind = vectors.schema["vec_id"].dataType
    centroids = first_centroids(vectors, k, seed, dimensions, scale)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    trees = plant_trees(vectors, dimensions, scale)
    for _ in range(rounds):
        centroids = lloyd_round(trees, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = cover_tree(centroids, leaf=1)
        for b in batches:
            for ids, blob in zip(b.column(0), b.column(1), strict=True):
                _, label, best = _labels(blob, centroids, seeds)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    out = materialize(trees.mapInArrow(assign, f"vec_id {kind.simpleString()}, cluster int, distance long"))
    discard(trees)
    return out, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; a row a cluster comes to the driver and goes out again."""
    spark = assigned.sparkSession
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    each = [(i, n, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in sorted(sums.items())]
    facts = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(read_table(spark, sf_dir, "embeddings")))


def lloyd_sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """The same in DuckDB, round by round, by comparing every vector with every centroid."""
    assign = lambda c: f"SELECT rn, min({{'d': list_sum(list_transform(list_zip(v.e, {c}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': cluster}}) AS b FROM v, {c} GROUP BY rn"
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({assign(f"c{i}")}),
m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY place) AS e FROM (SELECT b.c AS cluster, place, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT rn, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM v) JOIN a{i} USING (rn) GROUP BY ALL) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, CAST(coalesce(m{i}.e, c{i}.e) AS BIGINT[]) AS e FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS cluster, e FROM v QUALIFY cluster < {k}),
{", ".join(steps)},
z AS MATERIALIZED (SELECT rn, CAST(b.c AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance FROM ({assign(f"c{rounds}")}))
SELECT vec_id, z.cluster, distance, CAST(sum(distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN z USING (rn) JOIN c{rounds} AS c ON c.cluster = z.cluster"""


OP12_SQL = lloyd_sql()
