"""Scores: cosine, blend, decay, belief."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.sources.config import BETA, DAY_MS, FLOOR, IMPORTANCE, OTHER_BETA, OTHER_FLOOR, OTHER_IMPORTANCE, Decay

EPSILON = 1e-9
LN2 = 0.6931471805599453


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of both lengths, in double."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    return dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b) + F.lit(EPSILON))


def min_max(c: Column, by: Window | None = None) -> Column:
    """Within 0 and 1; 1 where all are equal. by: the rows of a request."""
    w = by if by is not None else Window.partitionBy(F.lit(1))
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(low == high, 1.0).otherwise((c - low) / F.when(low != high, high - low))


def blended(semantic: Column, ppr: Column, pagerank: Column, alpha: float = 0.5, gamma: float = 0.1, belief: Column | None = None, delta: float = 0.15, by: Window | None = None) -> Column:
    rest = 1 - alpha - gamma - (delta if belief is not None else 0)
    out = F.lit(alpha) * min_max(semantic, by) + F.lit(rest) * min_max(ppr, by) + F.lit(gamma) * min_max(pagerank, by)
    return out if belief is None else out + F.lit(delta) * min_max(belief, by)


def hybrid(vector: Column, hit: Column, weight: float = 0.4) -> Column:
    """The vector score, lower where no keyword occurs."""
    return F.when(F.coalesce(vector, F.lit(0.0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), vector * (F.lit(1 - weight) + hit * weight)))


def by_type(values: dict[str, float], other: float, kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for k, v in values.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(F.lit(other))


def importance(kind: Column) -> Column:
    return by_type(IMPORTANCE, OTHER_IMPORTANCE, kind)


def floor(kind: Column) -> Column:
    return by_type(FLOOR, OTHER_FLOOR, kind)


def recency(kind: Column, weight: Column, created: Column, accessed: Column, now_ms: int, d: Decay = Decay()) -> Column:
    """Weibull decay since the last access, or since creation; weight stretches the half-life."""
    days = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.when(accessed > 0, accessed).otherwise(created)) / F.lit(float(DAY_MS)))
    return F.exp(-(F.lit(LN2) / (F.lit(d.half_life_days) * F.exp(F.lit(d.mu) * weight))) * F.pow(days, by_type(BETA, OTHER_BETA, kind)))


def frequency(count: Column, created: Column, accessed: Column) -> Column:
    """Saturating in the number of accesses; frequent ones count more."""
    base = 1 - F.exp(-count / F.lit(5.0))
    span = F.greatest(F.lit(1.0), (accessed - created) / F.lit(float(DAY_MS)))
    gap = span / F.greatest(count - 1, F.lit(1))
    return F.when(count <= 1, F.greatest(F.lit(0.0), base)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (0.5 + 0.5 * F.exp(-gap / 30.0)))))


def composite(kind: Column, weight: Column, belief: Column, count: Column, created: Column, accessed: Column, now_ms: int, d: Decay = Decay()) -> Column:
    intrinsic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance(kind) * belief))
    return F.lit(d.recency) * recency(kind, weight, created, accessed, now_ms, d) + F.lit(d.frequency) * frequency(count, created, accessed) + F.lit(d.intrinsic) * intrinsic


def decayed(score: Column, kind: Column, comp: Column, base: float = 0.3) -> Column:
    return score * (F.lit(base) + F.lit(1 - base) * F.greatest(floor(kind), comp))


def boosted(score: Column, kind: Column, comp: Column, d: Decay = Decay()) -> Column:
    return score * F.least(F.lit(1.0), F.greatest(F.lit(d.boost_min), F.lit(d.boost_min) + F.lit(1 - d.boost_min) * F.greatest(floor(kind), comp)))


def belief(successes: Column, failures: Column) -> Column:
    """The mean of Beta(1 + successes, 1 + failures)."""
    return (1 + successes) / (2 + successes + failures)
