"""Messages, signals, recall logs and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_noise, shortened, tokens
from tessera.operators.mutate import stable_id


def ingested(messages: DataFrame, incoming: DataFrame, now_ms: int) -> DataFrame:
    """incoming: session_id, role, content, seq and maybe place, which orders messages of one seq. Each
    gets the next turn of its session; those without a seq come last."""
    last = messages.groupBy("session_id").agg(F.max("turn_index").alias("_last"))
    order = [F.asc_nulls_last("seq"), *(["place"] if "place" in incoming.columns else [])]
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    rows = incoming.withColumn("_n", n).join(last, "session_id", "left")
    turn = (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("int")
    rows = rows.withColumn("turn_index", turn)
    return rows.select(stable_id("m", F.col("session_id"), F.col("turn_index").cast("string")).alias("id"), "session_id", "turn_index", "role", "content", F.lit(False).alias("extracted"), F.lit(now_ms).cast("long").alias("created_at"))


def of_session(messages: DataFrame, session_id: str, limit: int | None = None) -> DataFrame:
    """Oldest first; with a limit, newest first."""
    own = messages.filter(F.col("session_id") == session_id)
    return own.orderBy("turn_index", "id") if limit is None else own.orderBy(F.desc("turn_index"), "id").limit(limit)


def unextracted(messages: DataFrame, session_id: str, limit: int = 50) -> DataFrame:
    return messages.filter((F.col("session_id") == session_id) & ~F.col("extracted")).orderBy("turn_index", "id").limit(limit)


def recent_extracted(messages: DataFrame, turns: int, mode: str = "reference") -> DataFrame:
    """Context of each session from its extracted messages, with its place (ord).

    A turn ends with a user's message. "reference": of the last 20 * turns rows, the oldest turns,
    each newest message first. "latest": the newest turns in order of time.
    """
    by = Window.partitionBy("session_id")
    rows = messages.filter("extracted").withColumn("_back", F.row_number().over(by.orderBy(F.desc("turn_index"), "id"))).filter(F.col("_back") <= turns * 20)
    user = (F.col("role") == "user").cast("int")
    before = F.coalesce(F.sum(user).over(by.orderBy(F.desc("_back")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_turn", before)
    if mode == "reference":
        rows = rows.filter(F.col("_turn") < turns)
        place = F.row_number().over(by.orderBy("_turn", "_back"))
    else:
        rows = rows.withColumn("_last", F.max("_turn").over(by)).filter(F.col("_turn") > F.col("_last") - turns)
        place = F.row_number().over(by.orderBy(F.desc("_back")))
    return rows.withColumn("ord", place).select(*messages.columns, "ord")


def mark_extracted(messages: DataFrame, upto: DataFrame) -> DataFrame:
    """upto: session_id, upto. Turns up to it count as extracted."""
    j = messages.join(upto, "session_id", "left")
    return j.withColumn("extracted", F.col("extracted") | F.coalesce(F.col("turn_index") <= F.col("upto"), F.lit(False))).select(*messages.columns)


def new_messages(batch: DataFrame, seen: DataFrame, counts: DataFrame, tail: int = 8) -> DataFrame:
    """batch: session_id, seq (from 0), fingerprint and more; seen: session_id, fingerprint of what
    is stored; counts: session_id, explicit, remembered. What is new starts at the explicit count,
    else at the remembered one unless the batch is shorter, else at the last tail rows."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    rows = batch.withColumn("_all", n).join(counts, "session_id", "left")
    kept = F.when(F.col("remembered") <= F.col("_all"), F.col("remembered"))
    explicit = F.when(F.col("explicit").isNotNull(), F.least(F.greatest("explicit", F.lit(0)), F.col("_all")))
    start = F.coalesce(explicit, kept, F.greatest(F.col("_all") - tail, F.lit(0)))
    rows = rows.filter(F.col("seq") >= start)
    return rows.join(seen.select("session_id", "fingerprint").distinct(), ["session_id", "fingerprint"], "left_anti").select(*batch.columns)


def pending(signals: DataFrame, session_id: str) -> DataFrame:
    return signals.filter((F.col("session_id") == session_id) & ~F.col("processed")).orderBy("turn_index", "id")


def mark_done(signals: DataFrame, ids: DataFrame) -> DataFrame:
    j = signals.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return j.withColumn("processed", F.col("processed") | F.coalesce("_hit", F.lit(False))).select(*signals.columns)


def protected_sessions(sessions: DataFrame, cutoff_ms: int) -> DataFrame:
    """sessions: session_id, running, updated_at."""
    return sessions.filter(F.col("running") | (F.col("updated_at") >= cutoff_ms)).select("session_id").distinct()


def retention(messages: DataFrame, recalled: DataFrame, protected: DataFrame, now_ms: int, days: int, budget: int | None) -> DataFrame:
    """What may go: kind, id. Oldest first within one budget, messages before recalls, or all without
    a budget; nothing if no session is protected."""
    cutoff = now_ms - max(1, days) * 86_400_000
    keep = protected.select("session_id").distinct()
    old = [t.filter(F.col("created_at") < cutoff).join(keep, "session_id", "left_anti").select(F.lit(k).alias("kind"), F.lit(i).alias("_k"), "id", "created_at") for i, (k, t) in enumerate((("message", messages), ("recall", recalled)))]
    rows = old[0].unionByName(old[1])
    if budget is not None:
        rows = rows.orderBy("_k", "created_at", "id").limit(max(1, budget))
    any_protected = keep.limit(1).select(F.lit(1).alias("_one"))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(any_protected), "_one", "left_semi").select("kind", "id")


def remaining(table: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    return table.join(gone.filter(F.col("kind") == kind).select("id"), "id", "left_anti")


def recall_rows(tiered: DataFrame, session_id: str, turn: int, now_ms: int) -> DataFrame:
    """Log rows of recalled nodes (id, tier, semantic, ppr, pagerank) that were shown."""
    rid = stable_id("r", F.lit(session_id), F.lit(str(turn)), F.col("id"))
    return tiered.filter("tier <> 'filtered'").select(rid.alias("id"), F.lit(session_id).alias("session_id"), F.lit(turn).cast("int").alias("turn_index"), F.col("id").alias("node_id"), "tier", "semantic", "ppr", "pagerank", F.lit(now_ms).cast("long").alias("created_at"))


def talk(messages: DataFrame) -> DataFrame:
    """What users and assistants said; stored JSON strings are unwrapped."""
    said = F.coalesce(F.get_json_object("content", "$.content"), F.col("content"))
    return messages.filter(F.col("role").isin("user", "assistant")).withColumn("content", said)


def without_noise(messages: DataFrame) -> DataFrame:
    return messages.filter(~is_noise(F.col("content")))


def last_turns(messages: DataFrame, keep: int = 5, tools: bool = True, cut: int = 6000) -> DataFrame:
    """Each session's last keep turns (a turn starts with a user's message): earlier ones as text of
    users and assistants, the last one with tool output, whose long texts lose their middle."""
    by = Window.partitionBy("session_id")
    user = (F.col("role") == "user").cast("int")
    rows = messages.withColumn("_users", F.sum(user).over(by))
    # A row belongs to the turn of the user's message at or before it.
    opened = F.sum(user).over(by.orderBy("turn_index", "id"))
    rows = rows.withColumn("_open", opened).withColumn("_turn", F.col("_users") - F.col("_open")).filter((F.col("_open") > 0) & (F.col("_turn") < keep))
    spoken = F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != "")
    rows = rows.filter(spoken | ((F.col("_turn") == 0) & F.lit(tools)))
    head, tail = int(cut * 0.6), int(cut * 0.3)
    n = F.char_length("content")
    middle = F.concat(F.substring("content", 1, head), F.lit("\n...[truncated "), (n - head - tail).cast("string"), F.lit(" chars]...\n"), F.substring(F.col("content"), -tail, tail))
    tool = F.col("role").isin("tool", "toolResult")
    rows = rows.withColumn("content", F.when(tool & (n > cut), middle).otherwise(F.col("content")))
    return rows.withColumn("tokens", tokens(F.char_length("content"))).select(*messages.columns, "tokens")


def compacted(nodes: DataFrame, most: int, quota: dict[str, int] | None = None) -> DataFrame:
    """The active set cut to most nodes, oldest first; skills stay, as do the newest of each type
    with a quota."""
    quota = {"TASK": 5, "EVENT": 10, "KNOWLEDGE": 10} if quota is None else quota
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("updated_at"), F.desc("id")))
    least = F.lit(0)
    for k, v in quota.items():
        least = F.when(F.col("type") == k, v).otherwise(least)
    loose = nodes.withColumn("_r", rank).filter((F.col("type") != "SKILL") & (F.col("_r") > least)).select("id", "updated_at")
    surplus = max(0, nodes.count() - most)
    return nodes.join(loose.orderBy("updated_at", "id").limit(surplus).select("id"), "id", "left_anti")


def rendered(messages: DataFrame, most: int = 800, with_turn: bool = True, note: str = "\n...(truncated {} chars)") -> DataFrame:
    """One text for each session: "[ROLE t=N]" and the message, cut, in order of turns."""
    head = F.concat(F.lit("["), F.upper(F.coalesce("role", F.lit("?"))), *([F.lit(" t="), F.col("turn_index").cast("string")] if with_turn else []), F.lit("]\n"))
    lines = messages.select("session_id", "turn_index", "id", F.concat(head, shortened(F.coalesce("content", F.lit("")), most, note)).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "id", "line"))), lambda x: x["line"])
    return lines.groupBy("session_id").agg(F.array_join(ordered, "\n\n---\n\n").alias("text"))

