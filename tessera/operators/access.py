"""Point reads, filters and statistics over nodes, edges, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalized_name

#: Order of the best-known nodes; the id settles ties.
TOP = [F.desc, F.desc, F.desc, F.asc]
TOP_COLUMNS = ("pagerank", "validated_count", "updated_at", "id")


def top_order() -> list[Column]:
    return [how(c) for how, c in zip(TOP, TOP_COLUMNS, strict=True)]


def active(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("status") == "active")


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == normalized_name(F.lit(name)))


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def edges_from(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("from_id") == node_id)


def edges_to(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.filter(F.col("to_id") == node_id)


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids (column id)."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def of_session(nodes: DataFrame, session_id: str) -> DataFrame:
    """Active nodes that the session is a source of, oldest first."""
    return active(nodes).filter(F.array_contains("source_sessions", session_id)).orderBy("updated_at", "id")


def flag_list(flags: Column) -> Column:
    """The flags, if they are a well-formed JSON array; else none."""
    return F.coalesce(F.from_json(flags, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def is_hot(flags: Column) -> Column:
    return F.coalesce(F.array_contains(flag_list(flags), "hot"), F.lit(False))


def hot(nodes: DataFrame) -> DataFrame:
    return active(nodes).filter(is_hot(F.col("flags")))


def scope_hot(nodes: DataFrame, scopes: list[str]) -> DataFrame:
    """Active nodes flagged as hot for any of the scopes."""
    wanted = F.array(*[F.lit(f"scope_hot:{s}") for s in scopes]).cast("array<string>")
    return active(nodes).filter(F.coalesce(F.arrays_overlap(flag_list(F.col("flags")), wanted), F.lit(False)))


def topics(nodes: DataFrame) -> DataFrame:
    return active(nodes).filter(F.col("type") == "TOPIC")


def edges_between(edges: DataFrame, from_nodes: DataFrame, to_nodes: DataFrame) -> DataFrame:
    joined = edges.join(from_nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return joined.join(to_nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*edges.columns)


def topic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    t = topics(nodes)
    return edges_between(edges, t, t)


def semantic_topic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges_between(edges, active(nodes).filter(F.col("type") != "TOPIC"), topics(nodes))


def full_info(nodes: DataFrame, edges: DataFrame, signals: DataFrame, node_id: str, last: int = 20) -> dict[str, DataFrame]:
    history = belief_history(signals, node_id, last)
    return {"node": by_id(nodes, node_id), "out": edges_from(edges, node_id), "in": edges_to(edges, node_id), "history": history}


def node_card(nodes: DataFrame, edges: DataFrame, signals: DataFrame, last: int = 20) -> DataFrame:
    """Of every node: numbers of edges out and in, and of its last belief signals."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_in"))
    seen = signals.groupBy(F.col("node_id").alias("id")).agg(F.least(F.count("*"), F.lit(last)).alias("n_signals"))
    cards = nodes.select("id", "name", "status").join(out, "id", "left").join(into, "id", "left").join(seen, "id", "left")
    return cards.na.fill(0, ["n_out", "n_in", "n_signals"])


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, key, n: active nodes, those of each type, hot ones; all edges and those of each name."""
    a = active(nodes)
    parts = [
        a.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("key"), "n"),
        a.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "key", "n"),
        a.agg(F.count_if(is_hot(F.col("flags"))).alias("n")).select(F.lit("hot").alias("what"), F.lit("").alias("key"), "n"),
        edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("").alias("key"), "n"),
        edges.groupBy(F.col("name").alias("key")).agg(F.count("*").alias("n")).select(F.lit("edge_name").alias("what"), "key", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def belief_stats(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: mean belief of active nodes, how many are above 0.7 and below 0.3, all signals."""
    total = signals.agg(F.count("*").alias("n_signals"))
    return active(nodes).agg(F.avg("belief").alias("avg_belief"), F.count_if(F.col("belief") > 0.7).alias("n_high"), F.count_if(F.col("belief") < 0.3).alias("n_low")).withColumn("_", F.lit(1)).join(total.withColumn("_", F.lit(1)), "_").drop("_")


def top_nodes(nodes: DataFrame, limit: int = 6) -> DataFrame:
    return active(nodes).orderBy(*top_order()).limit(limit)


def graph_summary(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """One row, text: the best-known nodes, a line each."""
    line = F.format_string("[%s] %s (pr=%.4f): %s", "type", "name", "pagerank", "description")
    top = top_nodes(nodes, limit).select(line.alias("line"), F.struct((-F.col("pagerank")).alias("a"), (-F.col("validated_count")).alias("b"), (-F.col("updated_at")).alias("c"), "id").alias("o"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"])
    return top.agg(F.array_join(lines, "\n").alias("text"))


def recalled_at(recalled: DataFrame, session_id: str, turn: int) -> DataFrame:
    return recalled.filter((F.col("session_id") == session_id) & (F.col("turn_index") == turn)).withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))


def recently_recalled(recalled: DataFrame, now_ms: int, hours: int = 168, limit: int = 50) -> DataFrame:
    """The newest recalls within the hours; of these each node's newest."""
    recent = recalled.filter(F.col("created_at") >= now_ms - hours * 3_600_000).orderBy(F.desc("created_at"), "id").limit(limit)
    first = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("created_at"), "id"))
    return recent.withColumn("_n", first).filter("_n = 1").drop("_n")


def recently_created(nodes: DataFrame, now_ms: int, hours: int = 168, limit: int = 50) -> DataFrame:
    return active(nodes).filter(F.col("created_at") >= now_ms - hours * 3_600_000).orderBy(F.desc("created_at"), "id").limit(limit)


def stale_candidates(nodes: DataFrame, now_ms: int, days: int, limit: int = 100) -> DataFrame:
    """Long unused tasks, states and doubtful nodes, least recently used first."""
    unused = (F.col("last_accessed_at") < now_ms - days * 86_400_000) | (F.col("last_accessed_at") == 0)
    doubtful = F.col("type").isin("STATUS", "TASK") | (F.col("belief") < 0.5)
    return active(nodes).filter(unused & doubtful).orderBy("last_accessed_at", "id").limit(limit).withColumn("composite", F.col("belief") * 0.3)


def belief_history(signals: DataFrame, node_id: str, limit: int = 20) -> DataFrame:
    return signals.filter(F.col("node_id") == node_id).orderBy(F.desc("created_at"), "id").limit(limit)


def belief_info(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "belief", "success_count", "failure_count")


def vector_hash(vectors: DataFrame, node_id: str) -> DataFrame:
    return vectors.filter(F.col("node_id") == node_id).select("node_id", "content_hash")


def flags_of(nodes: DataFrame, name: str) -> DataFrame:
    return by_name(nodes, name).select("name", "flags")


def scopes_of(scopes: DataFrame, session_id: str) -> DataFrame:
    return scopes.filter(F.col("session_id") == session_id).orderBy("scope_name")


def list_scopes(scopes: DataFrame) -> DataFrame:
    return scopes.groupBy("scope_name").agg(F.count("*").alias("n")).orderBy("scope_name")
