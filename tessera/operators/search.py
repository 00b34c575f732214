"""Full-text search: an inverted index as a table, BM25, and a substring fallback."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.access import top_nodes, top_order

K1, B = 1.2, 0.75
MAX_TERMS = 8


def token_list(*columns: str) -> Column:
    """Lower-case tokens of all columns; a mark between columns keeps phrases apart."""
    text = F.lower(F.concat_ws(" \x1e ", *[F.coalesce(c, F.lit("")) for c in columns]))
    return F.filter(F.split(text, r"[^\p{L}\p{N}\x{1e}]+"), lambda t: t != "")


def length(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != "\x1e"))


def index(nodes: DataFrame) -> DataFrame:
    """Postings id, term, positions, tf, of all nodes, whatever their status."""
    tokens = nodes.select("id", F.posexplode(token_list("name", "description", "content")).alias("pos", "term")).filter("term <> '\x1e'")
    return tokens.groupBy("id", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"))


def updated_index(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after the changed nodes (their new rows) were indexed again."""
    return postings.join(changed.select("id"), "id", "left_anti").unionByName(index(changed))


def phrases(query: str) -> list[list[str]]:
    """At most eight white-space terms; one with inner punctuation is a phrase of its tokens."""
    words = query.split()[:MAX_TERMS]
    found = [[t for t in re.split(r"[^\w]+|_", w.lower()) if t] for w in words]
    return [list(p) for p in dict.fromkeys(tuple(p) for p in found if p)]


def bm25(rows: DataFrame, phrases_: int, n: int, mean: float, df: list[int]) -> DataFrame:
    """rows: id, len, tf0, tf1 and so on; adds score."""
    score = F.lit(0.0)
    for k in range(phrases_):
        idf = max(math.log((n - df[k] + 0.5) / (df[k] + 0.5)), 1e-6)
        tf = F.col(f"tf{k}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + F.lit(B) * F.col("len") / F.lit(mean or 1.0)))
    return rows.withColumn("score", score)


def matches(nodes: DataFrame, query: str) -> DataFrame:
    """id, score (BM25 over all nodes) of active nodes that hold any phrase of the query. Two scans
    without a shuffle: one for the counts, one for the scores."""
    wanted = phrases(query)
    tokens = nodes.select("id", "status", token_list("name", "description", "content").alias("t"))

    def occurrences(phrase: list[str]) -> Column:
        def starts(t: Column, i: Column) -> Column:
            same = t == phrase[0]
            for k, p in enumerate(phrase[1:], 1):
                same = same & F.coalesce(F.get(F.col("t"), i + k) == p, F.lit(False))
            return same

        return F.size(F.filter("t", starts))

    rows = tokens.select("id", "status", length(F.col("t")).alias("len"), *[occurrences(p).alias(f"tf{k}") for k, p in enumerate(wanted)])
    total = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]).first()
    some = reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(wanted))])
    return bm25(rows.filter("status = 'active'").filter(some), len(wanted), total["n"], total["mean"], [total[f"df{k}"] for k in range(len(wanted))]).select("id", "score")


def indexed_matches(nodes: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """The same from a stored index (clustered by term): only the query's terms are read."""
    wanted = phrases(query)
    lengths = postings.groupBy("id").agg(F.sum("tf").alias("len"))
    total = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    parts = []
    for k, phrase in enumerate(wanted):
        at = postings.filter(F.col("term") == phrase[0]).select("id", "positions")
        for i, term in enumerate(phrase[1:], 1):
            nxt = postings.filter(F.col("term") == term).select("id", _shifted("positions", i).alias("_next"))
            at = at.join(nxt, "id").select("id", F.array_intersect("positions", "_next").alias("positions"))
        parts.append(at.filter("size(positions) > 0").select("id", F.lit(k).alias("k"), F.size("positions").alias("tf")))
    found = reduce(DataFrame.unionByName, parts)
    counted = {r["k"]: r["n"] for r in found.groupBy("k").agg(F.count("*").alias("n")).collect()}
    rows = found.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k in range(len(wanted))])
    rows = rows.join(nodes.filter("status = 'active'").select("id"), "id", "left_semi").join(lengths, "id")
    return bm25(rows, len(wanted), total["n"], total["mean"], [counted.get(k, 0) for k in range(len(wanted))]).select("id", "score")


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def like_matches(nodes: DataFrame, query: str) -> DataFrame:
    """Active nodes where any term is a substring; % and _ in terms are wildcards, ASCII case is
    ignored."""
    terms = query.split()[:MAX_TERMS]
    tests = [F.ilike(F.coalesce(c, F.lit("")), F.lit(f"%{t}%")) for t in terms for c in ("name", "description", "content")]
    return nodes.filter("status = 'active'").filter(reduce(lambda a, b: a | b, tests))


def search(nodes: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """Nodes in order of rank; without terms the best-known ones; without matches the substring
    matches, best-known first."""
    if not query.split():
        return top_nodes(nodes, limit)
    if phrases(query):
        found = matches(nodes, query).orderBy(F.desc(F.round("score", 6)), "id").limit(limit)
        if not found.isEmpty():
            return nodes.join(found, "id").orderBy(F.desc(F.round("score", 6)), "id").select(*nodes.columns)
    return like_matches(nodes, query).orderBy(*top_order()).limit(limit)
