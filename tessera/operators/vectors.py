"""Vectors: exact top-k, upserts, what awaits embedding or comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import EPSILON, dot, norm

EMBED_CHARS = 500


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def with_norms(vectors: DataFrame) -> DataFrame:
    """The norm as a stored column, so that searches don't compute it again."""
    return vectors.withColumn("norm", norm(F.col("embedding")))


def similarities(vectors: DataFrame, query: list[float]) -> DataFrame:
    """node_id, score: one pass, no shuffle; the query is a literal."""
    length = sum(float(v) ** 2 for v in query) ** 0.5
    own = F.col("norm") if "norm" in vectors.columns else norm(F.col("embedding"))
    score = dot(F.col("embedding"), vector(query)) / (own * F.lit(length) + F.lit(EPSILON))
    return vectors.select("node_id", score.alias("score"))


def top_k(nodes: DataFrame, vectors: DataFrame, query: list[float], k: int, min_score: float = 0.35) -> DataFrame:
    """node_id, score of the k best active nodes above min_score; none for a zero query or k <= 0."""
    rows = similarities(vectors, query)
    if k <= 0 or not any(query):
        return rows.limit(0)
    live = nodes.filter("status = 'active'").select(F.col("id").alias("node_id"))
    return rows.filter(F.col("score") > min_score).join(live, "node_id", "left_semi").orderBy(F.desc("score"), "node_id").limit(k)


def save(vectors: DataFrame, incoming: DataFrame, now_ms: int) -> DataFrame:
    """incoming: node_id, embedding, content_hash. An unchanged hash writes nothing; a changed or
    new one awaits comparison."""
    new = incoming.select("node_id", F.col("embedding").alias("_e"), F.col("content_hash").alias("_h"))
    j = vectors.join(new, "node_id", "full_outer")
    write = F.col("_h").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("_h"))
    return j.select("node_id", F.when(write, F.col("_e")).otherwise(F.col("embedding")).alias("embedding"), F.when(write, F.col("_h")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(write, F.lit(now_ms)).otherwise(F.col("updated_at")).alias("updated_at"), F.when(write, F.lit(0)).otherwise(F.col("dedup_checked_at")).alias("dedup_checked_at"))


def typed(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors of active nodes with type, validated_count and updated_at of the node."""
    live = nodes.filter("status = 'active'").select(F.col("id").alias("node_id"), "type", "validated_count", F.col("updated_at").alias("node_updated_at"))
    return vectors.join(live, "node_id")


def embed_text() -> Column:
    return F.concat(F.col("name"), F.lit(": "), F.coalesce("description", F.lit("")), F.lit("\n"), F.substring(F.coalesce("content", F.lit("")), 1, EMBED_CHARS))


def embedding_state(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, state (missing, changed, unchanged) of active nodes, by the hash of the embedded text."""
    h = F.md5(embed_text())
    rows = nodes.filter("status = 'active'").select("id", h.alias("hash")).join(vectors.select(F.col("node_id").alias("id"), "content_hash"), "id", "left")
    return rows.select("id", F.when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") == F.col("hash"), "unchanged").otherwise("changed").alias("state"))


def embedded(nodes: DataFrame, vectors: DataFrame, provider: Callable[[list[str]], list[list[float]]], force: bool = False) -> DataFrame:
    """New vectors (node_id, embedding, content_hash) of nodes whose text has changed, from a
    provider that takes batches of texts on the executors."""
    todo = nodes.join(embedding_state(nodes, vectors).filter(F.lit(force) | (F.col("state") != "unchanged")).select("id"), "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node_id": b["id"], "embedding": provider(b["text"].tolist()), "content_hash": b["hash"]})

    return todo.select("id", embed_text().alias("text"), F.md5(embed_text()).alias("hash")).mapInPandas(run, "node_id string, embedding array<float>, content_hash string")


def is_pending() -> Column:
    return F.col("dedup_checked_at") < F.col("updated_at")


def pending(vectors: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    return typed(vectors, nodes).filter(is_pending()).orderBy("dedup_checked_at", "updated_at", "node_id").limit(limit)


def checked_candidates(vectors: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    return typed(vectors, nodes).filter(~is_pending() & F.col("type").isin(*types))


def mark_checked(vectors: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    j = vectors.join(ids.select("node_id").distinct().withColumn("_hit", F.lit(True)), "node_id", "left")
    return j.withColumn("dedup_checked_at", F.when(F.col("_hit"), F.greatest(F.lit(now_ms), "updated_at")).otherwise(F.col("dedup_checked_at"))).select(*vectors.columns)
