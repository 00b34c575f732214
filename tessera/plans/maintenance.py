"""Upkeep: retention, then near-duplicates, then PageRank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import access, graph, messages, mutate, neardup, vectors
from tessera.sources.config import Config
from tessera.sources.snapshots import materialized


@dataclass
class Tables:
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    messages: DataFrame
    recalled: DataFrame


def dedup(t: Tables, now_ms: int, config: Config = Config(), full: bool = False, budgets: bool = True) -> tuple[Tables, DataFrame]:
    """Tables after merging near-duplicates, and the report. An incremental pass takes the oldest
    pending vectors within the budget; types that the pair budget blocked stay pending, and both
    ends of pairs that the merge budget left become pending again. A budget of 0 pending vectors
    means a full pass, and one of 0 pairs no cap. Without budgets one pass does what is there: all
    pending vectors, all their pairs, all merges."""
    full = full or config.dedup_max_pending == 0
    everything = vectors.typed(t.vectors, t.nodes)
    before = everything.filter(vectors.is_pending()).count()
    if full:
        batch = everything
        pairs = materialized(neardup.all_pairs(everything, config.dedup_threshold, None), "pairs")
    else:
        batch = vectors.pending(t.vectors, t.nodes, config.dedup_max_pending) if budgets else everything.filter(vectors.is_pending())
        batch = materialized(batch, "pending")
        others = everything.filter(~vectors.is_pending()).join(batch.select("type").distinct(), "type", "left_semi")
        pairs = materialized(neardup.incremental_pairs(batch, others, config.dedup_threshold), "pairs")
    if config.dedup_max_pairs == 0 or not budgets:
        kept, blocked = pairs, pairs.select("type").limit(0)
        steps = neardup.merge_steps_apart(kept, t.nodes, config.dedup_max_merges) if budgets else neardup.merge_steps(kept, t.nodes, None)
    else:
        kept, blocked = neardup.budgeted(pairs, config.dedup_max_pairs)
        kept = materialized(kept, "kept-pairs")
        steps = neardup.merge_steps(kept, t.nodes, config.dedup_max_merges)
    steps = materialized(steps, "merges")
    merges, left = steps.filter("step >= 0"), steps.filter("step < 0")
    final = materialized(neardup.final_targets(merges), "targets")
    nodes = mutate.merged_nodes(t.nodes, final, now_ms)
    edges = mutate.merged_edges(t.edges, final)
    done = batch.select("node_id", "type") if full else batch.select("node_id", "type").join(blocked, "type", "left_anti")
    ends = left.select(F.col("a").alias("node_id")).union(left.select("b")).distinct()
    done = done.join(ends, "node_id", "left_anti")
    checked = vectors.mark_checked(t.vectors, done.select("node_id"), now_ms)
    out = Tables(materialized(nodes, "nodes"), materialized(edges, "edges"), materialized(checked, "vectors"), t.messages, t.recalled)
    after = vectors.typed(out.vectors, out.nodes).filter(vectors.is_pending()).count()
    return out, neardup.report(before, after, done.count(), kept.count(), merges.count(), t.nodes.sparkSession)


def retire(t: Tables, protected: DataFrame, now_ms: int, days: int, budget: int | None) -> Tables:
    gone = materialized(messages.retention(t.messages, t.recalled, protected, now_ms, days, budget), "retired")
    return Tables(t.nodes, t.edges, t.vectors, messages.remaining(t.messages, gone, "message"), messages.remaining(t.recalled, gone, "recall"))


def rank(t: Tables, config: Config = Config()) -> Tables:
    live = access.active(t.nodes)
    scores = graph.pagerank(live, graph.adjacency(live, t.edges), None, config.damping, config.iterations)
    return Tables(materialized(mutate.set_pageranks(t.nodes, scores), "ranked"), t.edges, t.vectors, t.messages, t.recalled)


def maintain(t: Tables, protected: DataFrame, now_ms: int, days: int = 90, config: Config = Config(), budgets: bool = True) -> tuple[Tables, DataFrame]:
    """Without budgets nothing is left for a later run."""
    t = retire(t, protected, now_ms, days, config.retention_batch if budgets else None)
    t, report = dedup(t, now_ms, config, budgets=budgets)
    return rank(t, config), report


def top_report(pairs: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """what, a, b, value: the most similar pairs and the best-known nodes."""
    p = pairs.orderBy(F.desc("similarity"), "a", "b").limit(most).select(F.lit("pair").alias("what"), "a", "b", F.col("similarity").alias("value"))
    return p.unionByName(access.top_nodes(nodes, most).select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("pagerank").alias("value")))
