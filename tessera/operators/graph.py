"""The graph: undirected adjacency, breadth-first walks, PageRank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.snapshots import is_materialized, materialized

#: Graphs of at most so many adjacency rows are ranked in one task; larger ones by joins.
KERNEL_ROWS = 2_000_000


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, w: both directions of each edge whose ends are in nodes (id); w counts parallel
    edges, and a self-loop twice."""
    ids = nodes.select("id")
    live = edges.select("from_id", "to_id").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    both = live.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).unionAll(live.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("w"))


def walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Active nodes (with depth) within depth steps of the seeds (id), and the edges among all that
    was reached. The cap counts every reached node in order of (depth, smallest edge id, id);
    deprecated ones are passed through and counted, then dropped.

    Nodes nearer by come first, so each step keeps what the cap leaves room for, and what is reached
    has at most ``most`` rows: it is written and broadcast, and a step scans the edges once each way.
    """
    known = nodes.select("id")
    first = seeds.select("id").distinct().join(known, "id", "left_semi").orderBy("id").limit(most)
    room = most
    reached = frontier = materialized(first.select("id", F.lit(0).alias("depth"), F.lit("").alias("via")), "walk")
    both = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("id"), F.col("id").alias("via")).unionAll(edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("id"), F.col("id").alias("via")))
    for d in range(1, depth + 1):
        room -= frontier.count()
        if room <= 0:
            break
        step = both.join(F.broadcast(frontier.select(F.col("id").alias("at"))), "at", "left_semi").groupBy("id").agg(F.min("via").alias("via"))
        step = step.join(F.broadcast(reached.select("id")), "id", "left_anti").join(known, "id", "left_semi")
        frontier = materialized(step.orderBy("via", "id").limit(room).select("id", F.lit(d).alias("depth"), "via"), "walk")
        reached = reached.unionAll(frontier)
    ids = F.broadcast(reached.select("id"))
    among = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)
    found = nodes.filter("status = 'active'").join(F.broadcast(reached.select("id", "depth")), "id")
    return found, among


def _kernel(damping: float, iterations: int, personal: bool):
    nothing = pd.DataFrame({"id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})

    def rank(key, adj: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return nothing
        ids = nodes["id"].to_numpy()
        place = pd.Index(ids)
        src, dst, w = place.get_indexer(adj["src"]), place.get_indexer(adj["dst"]), adj["w"].to_numpy(float)
        degree = np.bincount(src, w, len(ids))
        teleport = nodes["seed"].to_numpy(float) if personal else np.ones(len(ids))
        if not teleport.sum():
            return nothing
        teleport /= teleport.sum()
        p = w / degree[src]
        score = teleport.copy()
        for _ in range(iterations):
            spread = np.bincount(dst, score[src] * p, len(ids))
            score = (1 - damping) * teleport + damping * (spread + score[degree == 0].sum() * teleport)
        return pd.DataFrame({"id": ids, "score": score})

    return rank


def pagerank(nodes: DataFrame, adj: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, iterations: int = 20, kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """id, score of nodes (id), for a fixed number of iterations. Teleport and the mass of nodes
    without neighbours go to the seeds evenly, or without seeds to all nodes. No valid seed: empty.

    A graph whose counted size is small goes through one task; a larger one is joined and summed
    in each iteration, with lineage cut in the shared folder.
    """
    ids = nodes.select("id")
    if seeds is None:
        marked = ids.withColumn("seed", F.lit(1.0))
    else:
        marked = ids.join(seeds.select("id").distinct().withColumn("seed", F.lit(1.0)), "id", "left").na.fill(0.0, ["seed"])
    adj = adj if is_materialized(adj) else materialized(adj, "adjacency")
    if adj.select(F.lit(0)).unionAll(ids.select(F.lit(0))).count() <= kernel_rows:
        left, right = adj.withColumn("all", F.lit(1)).groupBy("all"), marked.withColumn("all", F.lit(1)).groupBy("all")
        return left.cogroup(right).applyInPandas(_kernel(damping, iterations, seeds is not None), "id string, score double")
    marked = materialized(marked, "teleport")
    total = marked.agg(F.sum("seed")).first()[0]
    if not total:
        return ids.withColumn("score", F.lit(0.0)).limit(0)
    degree = adj.groupBy("src").agg(F.sum("w").alias("degree"))
    moves = materialized(adj.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("p")), "moves")
    base = materialized(marked.join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", (F.col("seed") / F.lit(total)).alias("t"), F.col("degree").isNull().alias("loose")), "base")
    scores = base.select("id", "t", "loose", F.col("t").alias("score"))
    for _ in range(iterations):
        lost = scores.filter("loose").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]  # one number
        got = moves.join(scores.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("p")).alias("g"))
        new = F.lit(1 - damping) * F.col("t") + F.lit(damping) * (F.coalesce("g", F.lit(0.0)) + F.lit(lost) * F.col("t"))
        scores = materialized(base.join(got, "id", "left").select("id", "t", "loose", new.alias("score")), "scores", scores)
    return scores.select("id", "score")


def gated_anchors(pool: DataFrame, seeds: DataFrame, k: int, semantic_least: float = 0.20, overlap_least: float = 0.25) -> DataFrame:
    """pool: best-known nodes with place (from 1), semantic (nullable) and overlap. Those that aren't
    seeds and touch the query, the first ceil(k / 5)."""
    good = (F.coalesce("semantic", F.lit(0.0)) >= semantic_least) | (F.col("overlap") >= overlap_least)
    rest = pool.join(seeds.select("id"), "id", "left_anti").filter(good)
    n = F.row_number().over(Window.orderBy("place"))  # a pool of at most a few dozen rows
    return rest.withColumn("_n", n).filter(F.col("_n") <= -(-k // 5)).drop("_n")
