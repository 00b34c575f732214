"""Ranking: blend, tiers, decay, and merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.sources.config import TIERS, Config, Decay

DIGITS = 9


def tier_at(place: Column, k: int) -> Column:
    return F.when(place <= -(-k // 3), "L1").when(place <= -(-2 * k // 3), "L2").when(place <= k, "L3").otherwise("filtered")


def tiered(rows: DataFrame, k: int, score: str = "combined") -> DataFrame:
    """place and tier by score; rounding before comparison makes ties alike on every engine."""
    n = F.row_number().over(Window.orderBy(F.desc(F.round(score, DIGITS)), "id"))
    return rows.withColumn("place", n).withColumn("tier", tier_at(F.col("place"), k))


def blended(rows: DataFrame, belief: bool = False) -> DataFrame:
    """rows: id, semantic, ppr, pagerank of one request's candidates; adds combined."""
    w = Window.partitionBy(F.lit(0))
    return rows.withColumn("combined", S.blended(F.col("semantic"), F.col("ppr"), F.col("pagerank"), belief=F.col("belief") if belief else None, by=w))


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of those with any score."""
    return rows.filter("combined > 0 or semantic > 0 or ppr > 0").orderBy(F.desc(F.round("combined", DIGITS)), "id").limit(k)


def composite(now_ms: int, weight: Column | float | None = None, d: Decay = Decay()) -> Column:
    """Of node columns. weight: importance in the half-life; the type's unless given."""
    w = S.importance(F.col("type")) if weight is None else F.lit(weight) if isinstance(weight, float) else weight
    return S.composite(F.col("type"), w, F.coalesce("belief", F.lit(0.5)), F.coalesce("access_count", F.lit(0)), F.col("created_at"), F.coalesce("last_accessed_at", F.lit(0)), now_ms, d)


def decayable(nodes: DataFrame) -> DataFrame:
    """What decay needs of a node, with defaults."""
    return nodes.select("id", "type", S.importance(F.col("type")).alias("importance"), F.coalesce("belief", F.lit(0.5)).alias("belief"), F.coalesce("access_count", F.lit(0)).alias("access_count"), "created_at", F.coalesce("last_accessed_at", F.lit(0)).alias("last_accessed_at"))


def stale(nodes: DataFrame, now_ms: int, d: Decay = Decay()) -> DataFrame:
    return nodes.withColumn("composite", composite(now_ms, None, d)).filter(F.col("composite") < d.stale_below).orderBy("composite", "id")


def with_decay(rows: DataFrame, now_ms: int, config: Config = Config()) -> DataFrame:
    """Tiered rows with node columns: combined shrinks by decay, then tiers anew. Importance in the
    half-life is even for all types here."""
    rows = rows.withColumn("composite", composite(now_ms, 0.5, config.decay))
    rows = rows.withColumn("combined", S.decayed(F.col("combined"), F.col("type"), F.col("composite")))
    return tiered(rows, config.recall_max_nodes)


def priority(tier: Column) -> Column:
    out = F.lit(0)
    for name, p in TIERS.items():
        out = F.when(tier == name, p).otherwise(out)
    return out


def merged_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tiered results (id, name, tier, ppr, place): for each name the best tier, the first one of
    equals; ppr is the greater of an id's scores."""
    both = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(priority(F.col("tier"))), "_src", "place"))
    ppr = F.max("ppr").over(Window.partitionBy("id"))
    return both.withColumn("ppr", ppr).withColumn("_n", best).filter("_n = 1").drop("_n", "_src")


def merged_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct by (from, to, name); the first result's edge, then the smallest id."""
    both = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("from_id", "to_id", "name").orderBy("_src", "id"))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_src")


def display_scores(rows: DataFrame) -> DataFrame:
    """ppr and pagerank of shown rows within 0 and 1; nulls stay."""
    w = Window.partitionBy(F.lit(0))
    out = rows
    for c in ("ppr", "pagerank"):
        out = out.withColumn(f"display_{c}", F.when(F.col(c).isNotNull(), S.min_max(F.col(c), w)))
    return out


def token_estimate(rows: DataFrame) -> DataFrame:
    n = F.sum(F.char_length("content") + F.char_length("description"))
    return rows.agg(F.ceil(F.coalesce(n, F.lit(0)) / 3).cast("long").alias("tokens"))


def picked(candidates: DataFrame, time: str, now_ms: int, seed: str, rate: float = 0.33) -> DataFrame:
    """One row drawn with probability proportional to exp(-rate * days), by exponential keys from a
    hash of (seed, id): -log(u) / weight is least. Repeatable, and distributed like any top-1."""
    days = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col(time)) / 86_400_000.0)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("id"))), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48) + 1)
    return candidates.withColumn("_key", -F.log(u) / F.exp(-F.lit(rate) * days)).orderBy("_key", "id").limit(1).drop("_key")
