"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize

MAX_TURNS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of the edges (a, b).

    Every turn each node goes to the smallest of its neighbours and itself, and on to where that one goes; edges
    within one place vanish and the others are told once.  A turn leaves at most half of the nodes, so few turns
    work on more than a fraction of the edges.  Nothing but whether edges are left comes to the driver; a hub's
    neighbours are counted with map-side combining and joined to its one row.
    """
    left = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), compact=True)
    moves: list[DataFrame] = []
    while not left.isEmpty():
        if len(moves) == MAX_TURNS:
            raise RuntimeError("components didn't settle")
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        on = low.select(F.col("node").alias("to"), F.col("to").alias("next"))
        move = materialize(low.join(on, "to").select("node", F.col("next").alias("to")), compact=True)
        moves.append(move)
        ends = left.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialize(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), compact=True)
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    names = moves[0].withColumnRenamed("to", "label")
    for move in moves[1:]:
        names = names.join(move.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialize(names, compact=True) if len(moves) > 1 else names
