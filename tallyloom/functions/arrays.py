"""Score vectors and label sets held in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which filters don't pass: what they ask for isn't computed a second time below."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distribution(v: Column) -> Column:
    """The vector over its sum; null where that is 0."""
    s = total(v)
    return F.when(s != 0, F.transform(v, lambda x: x.cast("double") / s))


def entropy(p: Column, base: float = 2.0) -> Column:
    """Shannon entropy of a distribution in units of ``base``; 0 log 0 counts as 0."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(F.lit(0.0)))) / F.ln(F.lit(base))


def soft_label(v: Column, alpha: float = 0.5) -> Column:
    """Non-negative scores plus alpha, normalised; null where all scores are 0."""
    up = F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    s, k = total(up), F.size(v)
    return F.when(s > 0, F.transform(up, lambda x: (x + alpha) / (s + alpha * k)))


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Kullback-Leibler divergence in nats, with both sides clipped at eps."""
    clip = lambda x: F.greatest(x, F.lit(eps))
    return total(F.zip_with(p, q, lambda x, y: clip(x) * F.ln(clip(x) / clip(y))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def brier(p: Column, q: Column) -> Column:
    """Mean squared difference over the classes."""
    return total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y))) / F.size(p)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of two sets; ``empty`` where both are."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(empty))


def by_rank(labels: Column, order: list[str]) -> Column:
    """Distinct labels in the given order; others after them, by name."""
    known = F.array(*map(F.lit, order))
    rest = F.array_sort(F.array_except(labels, known))
    return F.concat(F.filter(known, lambda c: F.array_contains(labels, c)), rest)


def labels_to_string(labels: Column, order: list[str]) -> Column:
    return F.array_join(by_rank(labels, order), "|")


def pair_by_rank(a: Column, b: Column, order: list[str], sep: str = "↔") -> Column:
    """The two labels in the given order, joined."""
    known = F.array(*map(F.lit, order))
    rank = lambda x: F.when(F.array_contains(known, x), F.array_position(known, x)).otherwise(999)
    return F.when(rank(a) <= rank(b), F.concat_ws(sep, a, b)).otherwise(F.concat_ws(sep, b, a))


def pair_by_name(a: Column, b: Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def error_type(true: Column, pred: Column) -> Column:
    """exact, under (labels missed), over (labels too many) or mixed."""
    missed, extra = F.size(F.array_except(true, pred)), F.size(F.array_except(pred, true))
    return F.when((missed == 0) & (extra == 0), "exact").when(extra == 0, "under").when(missed == 0, "over").otherwise("mixed")
