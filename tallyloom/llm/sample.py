"""Bounded training samples drawn with one count and one scan, without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that a training sample may hold; more raise an error.
MAX_CLASSES = 1000


def unit_hash(col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(col.cast("string"), F.lit(""))), F.lit(1 << 40)).cast("double") / float(1 << 40)


def per_class(rows: DataFrame, label: str, key: Column, each: int, most: int, seed: int = 5) -> DataFrame:
    """About ``each`` rows of every class (all of a smaller one), chosen by the hash of ``key``.

    The classes' counts are collected, at most ``MAX_CLASSES`` of them.  The sample has about classes * each rows,
    fewer of each if that is more than ``most``, at any size of the input; the limit at twice that holds even
    where one key fills the table.
    """
    counts = rows.groupBy(label).count().orderBy(label).limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not counts:
        return rows.limit(0)
    each = max(1, min(each, most // len(counts)))
    chance = F.create_map(*(x for c in counts for x in (F.lit(c[0]), F.lit(min(1.0, each / c["count"])))))
    return rows.where(unit_hash(key, seed) < F.element_at(chance, F.col(label))).limit(2 * each * len(counts))
