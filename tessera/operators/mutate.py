"""Changes as pure functions: a table and what changes it, giving the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import belief
from tessera.functions.text import normalized_name
from tessera.operators.access import flag_list
from tessera.sources.config import NODE_TYPES
from tessera.sources.snapshots import materialized

#: What a changing side may hold to be broadcast, as JSON.
BROADCAST_CHARS = 8_000_000
#: How many ids may be.
BROADCAST_IDS = 100_000


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id from a row's natural key: the same whenever a task runs again."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def _strings(flags: Column) -> Column:
    return F.to_json(flags)


def upsert_nodes(nodes: DataFrame, incoming: DataFrame, now_ms: int, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """incoming: name, type, description, content, session_id, flags (array), seq.

    A known name keeps its type, gets the last description and content by seq, counts every
    mention, gathers sessions and flags, and becomes active again. A new one takes the first type.
    Mentions are written, measured and, within broadcast_chars, broadcast.
    """
    rows = incoming.withColumn("name", normalized_name(F.col("name")))
    first, last = F.min_by("type", "seq"), F.max(F.struct("seq", "description", "content"))
    sessions = F.transform(F.array_sort(F.collect_list(F.struct("seq", "session_id"))), lambda x: x["session_id"])
    folded = rows.groupBy("name").agg(first.alias("_type"), last.alias("_last"), F.count("*").alias("_n"), sessions.alias("_sessions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("_flags"))
    # Written first: by a name that the plan knows as a constant, the join would broadcast all nodes.
    folded = materialized(folded, "mentions")
    touched = F.col("_n").isNotNull()
    none = F.array().cast("array<string>")
    chars = folded.agg(F.coalesce(F.sum(F.char_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if chars > broadcast_chars:
        merged = nodes.join(folded, "name", "full_outer")
    else:  # few mentions: nodes, with their texts, stay where they are
        known = nodes.select("name").join(F.broadcast(folded.select("name")), "name", "left_semi").distinct()
        new = folded.join(F.broadcast(known), "name", "left_anti")
        merged = nodes.join(F.broadcast(folded), "name", "left").unionByName(new, allowMissingColumns=True)
    changed = {
        "id": F.coalesce("id", stable_id("n", F.col("name"))),
        "type": F.coalesce("type", "_type"),
        "description": F.when(touched, F.col("_last.description")).otherwise(F.col("description")),
        "content": F.when(touched, F.col("_last.content")).otherwise(F.col("content")),
        "status": F.when(touched, "active").otherwise(F.col("status")),
        "validated_count": F.coalesce("validated_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "source_sessions": F.array_distinct(F.concat(F.coalesce("source_sessions", none), F.coalesce("_sessions", none))),
        "flags": F.when(touched, _strings(F.array_union(flag_list(F.coalesce("flags", F.lit("[]"))), F.coalesce("_flags", none)))).otherwise(F.col("flags")),
        "created_at": F.coalesce("created_at", F.lit(now_ms)),
        "updated_at": F.when(touched, F.lit(now_ms)).otherwise(F.col("updated_at")),
        "pagerank": F.coalesce("pagerank", F.lit(0.0)),
        "belief": F.coalesce("belief", F.lit(0.5)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("success_count", "failure_count")},
        **{c: F.coalesce(c, F.lit(0).cast("long")) for c in ("access_count", "last_accessed_at")},
    }
    return merged.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def deprecate(nodes: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = nodes.join(hit, "id", "left")
    return joined.withColumn("status", F.when(F.col("_hit"), "deprecated").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("updated_at"))).select(*nodes.columns)


def set_flags(nodes: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """changes: id, new_flags (array). Named nodes get these flags and become active."""
    joined = nodes.join(changes.select("id", "new_flags"), "id", "left")
    hit = F.col("new_flags").isNotNull()
    return joined.withColumn("flags", F.when(hit, _strings(F.col("new_flags"))).otherwise(F.col("flags"))).withColumn("status", F.when(hit, "active").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_at"))).select(*nodes.columns)


def add_flag(nodes: DataFrame, ids: DataFrame, flag: str, now_ms: int) -> DataFrame:
    """Appends "hot" or "scope_hot:<scope>" where it is absent."""
    wanted = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return set_flags(nodes, wanted.select("id", F.array_union(flag_list(F.col("flags")), F.array(F.lit(flag))).alias("new_flags")), now_ms)


def merged_nodes(nodes: DataFrame, merges: DataFrame, now_ms: int) -> DataFrame:
    """merges: merge_id, keep_id. The kept node gets the longer texts, all sessions and flags, the
    summed counts and the belief of the summed signals; the merged ones are deprecated."""
    gone = merges.select(F.col("merge_id").alias("id"), "keep_id")
    lost = nodes.join(gone, "id")
    longest = F.max(F.struct(F.char_length("content").alias("n"), F.col("content").alias("v")))
    longest_d = F.max(F.struct(F.char_length("description").alias("n"), F.col("description").alias("v")))
    sums = lost.groupBy(F.col("keep_id").alias("id")).agg(
        F.sum("validated_count").alias("_v"), F.sum("success_count").alias("_s"), F.sum("failure_count").alias("_f"), longest.alias("_c"), longest_d.alias("_d"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_sessions")))).alias("_ss"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(flag_list(F.col("flags")))))).alias("_fl"),
    )
    j = nodes.join(sums, "id", "left").join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    kept = F.col("_v").isNotNull()
    s, f = F.col("success_count") + F.coalesce("_s", F.lit(0.0)), F.col("failure_count") + F.coalesce("_f", F.lit(0.0))
    changed = {
        "validated_count": F.col("validated_count") + F.coalesce("_v", F.lit(0)),
        "belief": F.when(kept & (s + f > 0), belief(s, f)).otherwise(F.col("belief")),
        "success_count": s,
        "failure_count": f,
        "content": F.when(kept & (F.col("_c.n") > F.char_length("content")), F.col("_c.v")).otherwise(F.col("content")),
        "description": F.when(kept & (F.col("_d.n") > F.char_length("description")), F.col("_d.v")).otherwise(F.col("description")),
        "source_sessions": F.when(kept, F.array_union("source_sessions", "_ss")).otherwise(F.col("source_sessions")),
        "flags": F.when(kept, _strings(F.array_union(flag_list(F.col("flags")), F.col("_fl")))).otherwise(F.col("flags")),
        "status": F.when(F.col("_gone"), "deprecated").otherwise(F.col("status")),
        "updated_at": F.when(kept | F.col("_gone"), F.lit(now_ms)).otherwise(F.col("updated_at")),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in nodes.columns])


def merged_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges moved to the kept nodes; no self-loops, and one edge (the smallest id) per key."""
    to = merges.select("merge_id", "keep_id")
    for end in ("from_id", "to_id"):
        edges = edges.join(to.withColumnRenamed("merge_id", end), end, "left").withColumn(end, F.coalesce("keep_id", end)).drop("keep_id")
    rest = [c for c in edges.columns if c not in ("from_id", "to_id", "name")]
    one = F.min(F.struct("id", *[c for c in rest if c != "id"]))
    found = edges.filter("from_id <> to_id").groupBy("from_id", "to_id", "name").agg(one.alias("e"))
    return found.select("e.id", "from_id", "to_id", "name", *[f"e.{c}" for c in rest if c != "id"])


def set_pageranks(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """scores: id, score. Active nodes that are named get it; others keep theirs."""
    joined = nodes.join(scores.select("id", "score"), "id", "left")
    return joined.withColumn("pagerank", F.when(F.col("status") == "active", F.coalesce("score", "pagerank")).otherwise(F.col("pagerank"))).select(*nodes.columns)


def upsert_edges(edges: DataFrame, incoming: DataFrame, nodes: DataFrame, now_ms: int) -> DataFrame:
    """incoming: from_id, to_id, name, description, session_id, seq. Ends must be active; a known
    key gets the last description only."""
    live = nodes.filter("status = 'active'").select("id")
    rows = incoming.join(live.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(live.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    key = ["from_id", "to_id", "name"]
    folded = rows.groupBy(*key).agg(F.max_by("description", "seq").alias("_d"), F.min_by("session_id", "seq").alias("_s"))
    j = edges.join(folded, key, "full_outer")
    changed = {
        "id": F.coalesce("id", stable_id("e", *map(F.col, key))),
        "description": F.coalesce("_d", "description"),
        "session_id": F.coalesce("session_id", "_s"),
        "created_at": F.coalesce("created_at", F.lit(now_ms)),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in edges.columns])


def update_fields(nodes: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """changes: id, new_description, new_content, new_type; nulls leave a field, and a row of nulls
    leaves the node. Types must be known ones."""
    ok = changes.filter(F.col("new_type").isNull() | F.col("new_type").isin(*NODE_TYPES)).filter("new_description is not null or new_content is not null or new_type is not null")
    j = nodes.join(ok.withColumn("_hit", F.lit(True)), "id", "left")
    for c in ("description", "content", "type"):
        j = j.withColumn(c, F.coalesce(f"new_{c}", c))
    return j.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("updated_at"))).select(*nodes.columns)


def record_access(nodes: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """Each mention of an id counts."""
    j = nodes.join(ids.groupBy("id").agg(F.count("*").alias("_n")), "id", "left")
    return j.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed_at", F.when(F.col("_n") > 0, F.lit(now_ms)).otherwise(F.col("last_accessed_at"))).select(*nodes.columns)


def removed(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Active nodes of the ids are deprecated and lose their edges."""
    hit = nodes.filter("status = 'active'").join(ids.select("id").distinct(), "id", "left_semi").select("id")
    rest = edges.join(hit.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(hit.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*edges.columns)
    return deprecate(nodes, hit, now_ms), rest


def session_links(new_nodes: DataFrame, session_nodes: DataFrame, edge_name: str = "属于会话") -> DataFrame:
    """Incoming edges from each new node (id, session_id) to its session's node (id, session_id)."""
    s = session_nodes.select(F.col("id").alias("to_id"), "session_id")
    rows = new_nodes.select(F.col("id").alias("from_id"), "session_id").join(s, "session_id").filter("from_id <> to_id")
    return rows.select("from_id", "to_id", F.lit(edge_name).alias("name"), F.lit("").alias("description"), "session_id", F.lit(0).cast("long").alias("seq"))


def finalized(nodes: DataFrame, edges: DataFrame, skills: DataFrame, links: DataFrame, invalid: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """skills: as for upsert_nodes, taken as SKILL; links: from_name, to_name, name, description,
    session_id, seq; invalid: id."""
    nodes = upsert_nodes(nodes, skills.withColumn("type", F.lit("SKILL")), now_ms)
    ids = nodes.select("name", "id")
    named = links.join(ids.toDF("from_name", "from_id"), "from_name").join(ids.toDF("to_name", "to_id"), "to_name").select("from_id", "to_id", "name", "description", "session_id", "seq")
    invalid = materialized(invalid.select("id").distinct(), "invalid")
    if invalid.count() <= BROADCAST_IDS:
        invalid = F.broadcast(invalid)
    return deprecate(nodes, invalid, now_ms), upsert_edges(edges, named, nodes, now_ms)


def set_scopes(scopes: DataFrame, session_id: str, names: DataFrame, now_ms: int) -> DataFrame:
    """names: scope_name. The session's bindings are replaced; blanks and repeats go."""
    new = names.select(F.trim("scope_name").alias("scope_name")).filter("scope_name <> ''").distinct()
    return scopes.filter(F.col("session_id") != session_id).unionByName(new.select("scope_name", F.lit(session_id).alias("session_id"), F.lit(now_ms).cast("long").alias("created_at")))


def applied_beliefs(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """signals: node_id, signal_type (supported, contradicted or null), weight. The nodes' next
    version with before and after; sums commute, so order doesn't matter."""
    plus = F.sum(F.when(F.col("signal_type") == "supported", F.col("weight")).otherwise(0.0))
    minus = F.sum(F.when(F.col("signal_type") == "contradicted", F.col("weight")).otherwise(0.0))
    sums = signals.groupBy(F.col("node_id").alias("id")).agg(plus.alias("_s"), minus.alias("_f"))
    j = nodes.join(sums, "id", "left").withColumn("before", F.col("belief"))
    s, f = F.col("success_count") + F.coalesce("_s", F.lit(0.0)), F.col("failure_count") + F.coalesce("_f", F.lit(0.0))
    j = j.withColumn("success_count", s).withColumn("failure_count", f)
    j = j.withColumn("belief", F.when(F.col("_s").isNotNull(), belief(F.col("success_count"), F.col("failure_count"))).otherwise(F.col("belief")))
    return j.withColumn("delta", F.col("belief") - F.col("before")).drop("_s", "_f")


def named_beliefs(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Signals from updates by node name (node_name, verdict, weight, session_id, and others that
    are kept)."""
    u = updates.withColumn("name", normalized_name(F.col("node_name")))
    kept = [c for c in updates.columns if c not in ("node_name", "verdict", "weight", "session_id")]
    return u.join(nodes.select("name", F.col("id").alias("node_id")), "name").select("node_id", F.col("verdict").alias("signal_type"), "weight", "session_id", *kept)


def session_support(nodes: DataFrame, session_id: str, logged: float = 0.3, applied: float = 1.0) -> DataFrame:
    """Support for all of a session's nodes at its end: what is logged and what is applied differ."""
    own = nodes.filter("status = 'active'").filter(F.array_contains("source_sessions", session_id))
    return own.select(F.col("id").alias("node_id"), F.lit("supported").alias("signal_type"), F.lit(logged).alias("logged_weight"), F.lit(applied).alias("weight"), F.lit(session_id).alias("session_id"))


def appended(log: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The log with rows whose key it lacks; of repeats among the rows, one."""
    new = rows.join(log.select(key), key, "left_anti").dropDuplicates([key])
    return log.unionByName(new.select(*log.columns))


def last_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
