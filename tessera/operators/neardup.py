"""Near-duplicate nodes by cosine within a type, and their greedy merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import EPSILON, norm
from tessera.sources.snapshots import materialized

#: Vectors per block of a type. A pair of blocks is one unit of work, so a type that holds most
#: vectors is spread over many tasks.
BLOCK = 2048
#: Rows of a block that are multiplied at once, which bounds a task's matrices.
STRIP = 512
#: What a matrix product may differ from the sum in order.
SLACK = 1e-9


def blocked(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """df (node_id, embedding, type) with norm, and its block within the type; the number of blocks
    follows from each type's count. Types are few, so their counts are broadcast."""
    n = df.groupBy("type").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    return df.join(F.broadcast(n), "type").withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")).withColumn("norm", norm(F.col("embedding")))


def _unit(threshold: float, ordered: bool, first: int | None):
    """Of the rows of one unit (type, i, j), the similar pairs of its two sides. Products of matrices
    find the candidates, sums in order decide. It goes to executors whole, without
    this module."""

    def matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings as columns, shorter ones filled up with 0, and their lengths."""
        size = values.value_lengths().to_numpy(zero_copy_only=False)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        out = np.zeros((len(size), size.max(initial=0)))
        out[np.arange(out.shape[1]) < size[:, None]] = flat
        return np.ascontiguousarray(out.T), size

    def similar(x: np.ndarray, size: np.ndarray, length: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Similarities of rows p with rows q, each a sum in order over the shorter of both."""
        total, least = np.zeros(len(p)), np.minimum(size[p], size[q])
        even = len(np.unique(size)) < 2
        for k in range(len(x)):
            product = x[k][p] * x[k][q]
            total += product if even else np.where(k < least, product, 0.0)
        return total / (length[p] * length[q] + EPSILON)

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, length = rows["node_id"].combine_chunks(), rows["norm"].to_numpy()
        x, size = matrix(rows["embedding"].combine_chunks())
        side = rows["side"].to_numpy()
        own = key[1].as_py() == key[2].as_py() and ordered  # a block with itself
        left, right = (np.arange(len(side)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        place = np.unique(np.array(ids.to_pylist(), object), return_inverse=True)[1]
        y, best = x[:, right], None

        def batch(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q)), pa.repeat(key[0], len(p)), pa.array(s)], ["a", "b", "type", "similarity"])

        with np.errstate(all="ignore"):
            for k in range(0, len(left), STRIP):
                strip = left[k : k + STRIP]
                near = x[:, strip].T @ y / (length[strip][:, None] * length[right] + EPSILON)
                i, j = np.nonzero(~(near < threshold - SLACK))  # not a number counts as similar, as in SQL
                p, q = strip[i], right[j]
                if ordered:
                    kept = place[p] < place[q] if own else place[p] != place[q]
                    p, q = p[kept], q[kept]
                    turned = place[p] > place[q]
                    p, q = np.where(turned, q, p), np.where(turned, p, q)
                else:
                    kept = place[p] != place[q]
                    p, q = p[kept], q[kept]
                s = similar(x, size, length, p, q)
                kept = ~(s < threshold)
                p, q, s = p[kept], q[kept], s[kept]
                if first is not None:
                    if best is not None:
                        p, q, s = (np.concatenate(c) for c in zip(best, (p, q, s), strict=True))
                    order = np.lexsort((place[q], place[p]))[:first]
                    best = p[order], q[order], s[order]
                    continue
                for at in range(0, len(p), 100_000):
                    yield batch(p[at : at + 100_000], q[at : at + 100_000], s[at : at + 100_000])
        if best is not None:
            yield batch(*best)

    return pairs


def scored_pairs(left: DataFrame, right: DataFrame, threshold: float, ordered: bool, first: int | None = None) -> DataFrame:
    """a, b, type, similarity of pairs of a type at or above the threshold. Each pair of blocks of a
    type is a unit of work. ordered: both sides are the same rows, and a < b. first: only the first so
    many pairs by (a, b) of each unit, among which are the first ones of all."""
    def side(df: DataFrame, k: Column, i: Column, j: Column) -> DataFrame:
        return df.filter("node_id is not null and norm is not null").select("type", i.alias("i"), j.alias("j"), k.alias("side"), "node_id", "embedding", "norm")

    each = F.explode(F.sequence(F.lit(0), F.col("other") - 1))
    if ordered:
        rows = left.withColumnRenamed("blocks", "other").withColumn("other", each)
        rows = side(rows, (F.col("block") > F.col("other")).cast("int"), F.least("block", "other"), F.greatest("block", "other"))
    else:
        a, b = (df.join(F.broadcast(other.groupBy("type").agg(F.first("blocks").alias("other"))), "type").withColumn("other", each) for df, other in ((left, right), (right, left)))
        rows = side(a, F.lit(0), F.col("block"), F.col("other")).unionAll(side(b, F.lit(1), F.col("other"), F.col("block")))
    return rows.groupBy("type", "i", "j").applyInArrow(_unit(threshold, ordered, first), f"a string, b string, type {left.schema['type'].dataType.simpleString()}, similarity double")


def all_pairs(vectors: DataFrame, threshold: float = 0.90, limit: int | None = 1000) -> DataFrame:
    """vectors: node_id, embedding, type. The first pairs by (type, a, b), then best first."""
    rows = blocked(vectors)
    pairs = scored_pairs(rows, rows, threshold, True, limit)
    if limit is not None:
        pairs = pairs.orderBy("type", "a", "b").limit(limit)
    return materialized(pairs, "all-pairs").orderBy(F.desc("similarity"), "a", "b")


def incremental_pairs(pending: DataFrame, checked: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Pairs among the pending vectors, and of pending with checked ones."""
    p, c = blocked(pending), blocked(checked)
    inner = scored_pairs(p, p, threshold, True)
    return inner.unionByName(scored_pairs(p, c, threshold, False))


def budgeted(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first pairs within the budget by (type, a, b), and the types that it blocked, whose
    vectors stay pending."""
    n = F.row_number().over(Window.orderBy("type", "a", "b"))
    first = pairs.orderBy("type", "a", "b").limit(most + 1)
    ranked = first.withColumn("_n", n)
    kept = ranked.filter(F.col("_n") <= most).drop("_n")
    return kept, pairs.join(kept.select("a", "b"), ["a", "b"], "left_anti").select("type").distinct()


def comparisons(pending: DataFrame, checked: DataFrame) -> DataFrame:
    """type, n: how many pairs an incremental pass compares."""
    p = pending.groupBy("type").agg(F.count("*").alias("p"))
    c = checked.groupBy("type").agg(F.count("*").alias("c"))
    return p.join(c, "type", "left").select("type", F.expr("p * (p - 1) div 2 + p * coalesce(c, 0)").alias("n"))


def groups(pairs: DataFrame) -> DataFrame:
    """node, label: the smallest node that is reachable over pairs. Labels pass along pairs and
    then jump to their own labels, written to the shared folder after each round."""
    links = materialized(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "links")
    labels, left = materialized(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels"), 1
    while left:
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = materialized(met.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), "labels")
        left = new.filter("label <> old").count()
        labels = new.select("node", "label")
    return labels


def merge_steps(pairs: DataFrame, nodes: DataFrame, budget: int | None = 200) -> DataFrame:
    """a, b, merge_id, keep_id, similarity, step. Best pairs first; a pair with a merged node is
    skipped; the more validated node stays, else the newer, else a; counts grow as merges go. Pairs
    behind the last merge of the budget come without merge_id, keep_id and with step -1; a budget of
    0 merges nothing and leaves nothing behind. The order matters, so the pairs, which a budget
    bounds, go through one task. Without a budget the groups that pairs connect, which don't touch
    each other, are merged apart, and steps count within a group."""
    info = nodes.select("id", "validated_count", "updated_at")
    rows = pairs.join(info.toDF("a", "va", "ua"), "a").join(info.toDF("b", "vb", "ub"), "b")
    if budget is None:
        rows = rows.join(groups(pairs).toDF("a", "all"), "a")
    else:
        rows = rows.withColumn("all", F.lit(1))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(r=p["similarity"].round(9)).sort_values(["r", "a", "b"], ascending=[False, True, True])
        count = {**dict(zip(p["a"], p["va"], strict=True)), **dict(zip(p["b"], p["vb"], strict=True))}
        gone, out, left = set(), [], []
        for row in p.itertuples() if budget != 0 else ():
            if budget is not None and len(out) >= budget:
                left.append((row.a, row.b, None, None, row.similarity, -1))
                continue
            if row.a in gone or row.b in gone:
                continue
            keep_a = count[row.a] > count[row.b] or (count[row.a] == count[row.b] and row.ua >= row.ub)
            keep, lost = (row.a, row.b) if keep_a else (row.b, row.a)
            count[keep] += count[lost]
            gone.add(lost)
            out.append((row.a, row.b, lost, keep, row.similarity, len(out)))
        return pd.DataFrame(out + left, columns=["a", "b", "merge_id", "keep_id", "similarity", "step"])

    return rows.groupBy("all").applyInPandas(merge, "a string, b string, merge_id string, keep_id string, similarity double, step int")


def merge_steps_apart(pairs: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """The rows of merge_steps for pairs that nothing bounds: groups are merged apart, and of all
    merges, best pairs first, those within the budget stay."""
    columns, order = ["a", "b", "merge_id", "keep_id", "similarity", "step"], [F.desc("r"), "a", "b"]
    steps = materialized(merge_steps(pairs, nodes, None), "apart").withColumn("r", F.round("similarity", 9))
    first = steps.orderBy(*order).limit(budget).withColumn("step", F.row_number().over(Window.orderBy(*order)) - 1)
    first = materialized(first, "first")
    if not budget or first.count() < budget:
        return first.select(*columns)
    last = first.orderBy(F.desc("step")).first()
    r = F.round("similarity", 9)
    behind = (r < last["r"]) | ((r == last["r"]) & ((F.col("a") > last["a"]) | ((F.col("a") == last["a"]) & (F.col("b") > last["b"]))))
    none = F.lit(None).cast("string")
    left = pairs.filter(behind).select("a", "b", none.alias("merge_id"), none.alias("keep_id"), "similarity", F.lit(-1).alias("step"))
    return first.select(*columns).unionByName(left)


def greedy_merges(pairs: DataFrame, nodes: DataFrame, budget: int | None = 200) -> DataFrame:
    """merge_id, keep_id, similarity, step of the merges of merge_steps."""
    return merge_steps(pairs, nodes, budget).filter("step >= 0").select("merge_id", "keep_id", "similarity", "step")


def final_targets(merges: DataFrame, rounds: int = 30) -> DataFrame:
    """Merges whose kept node was merged later lead to where that went; chains end in few doublings."""
    m = merges.select("merge_id", "keep_id")
    for _ in range(rounds):
        nxt = m.select(F.col("merge_id").alias("keep_id"), F.col("keep_id").alias("_next"))
        longer = m.join(nxt, "keep_id", "inner")
        if longer.isEmpty():
            return m
        m = m.join(nxt, "keep_id", "left").select("merge_id", F.coalesce("_next", "keep_id").alias("keep_id"))
    return m


def report(before: int, after: int, checked: int, pairs: int, merged: int, spark) -> DataFrame:
    return spark.createDataFrame([(before, after, checked, pairs, merged)], "pending_before long, pending_after long, checked long, pairs long, merged long")
