"""Streams of messages and events, and folds of event logs into state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators import messages as M
from tessera.sources.config import Config
from tessera.sources.snapshots import Store


def file_stream(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """Of the table's file, or of the files in its folder, where new ones are found as they come. The
    pattern matches the table's name alone; a stream takes a single file only by a pattern."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def drained(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now; each batch goes to take(df, batch number)."""
    query = stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, store: Store, checkpoint: str, clock: Callable[[int], int], name: str = "ingest", tag: str = "memory") -> None:
    """stream: session_id, role, content, seq and, where a seq may repeat, place. Batches are appended
    one after another: each message gets its session's next turn, without an injected block. Only the
    batch's sessions are looked up, and only its rows are written. A batch that runs again after a loss
    is known by its number and changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        known = store.read("messages").join(batch.select("session_id").distinct(), "session_id", "left_semi")
        rows = M.ingested(known, batch.withColumn("content", T.without_memory_block(F.col("content"), tag)), clock(number))
        store.append("messages", rows, f"{name}-{number}")

    drained(stream, take, checkpoint)


def turn_counts(stream: DataFrame, every: int) -> DataFrame:
    """session_id, turns, due: running turn counts of sessions; due at each every-th turn. State per
    key, kept by the engine."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        before = n
        n += sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [n], "due": [n // every > before // every]})

    return stream.groupBy("session_id").applyInPandasWithState(count, "session_id string, turns long, due boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, key: list[str], late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def toggles(log: DataFrame) -> DataFrame:
    """log: session_key, seq, action (on, off), target (all, recall, extract). The state after all
    commands: disabled, recall_disabled, extract_disabled. Turning one part on after everything was
    turned off leaves the other part off."""

    def step(s: Column, e: Column) -> Column:
        off = e["action"] == "off"
        recall, extract = e["target"] == "recall", e["target"].isin("extract", "extraction")
        other = ~(recall | extract)
        disabled = F.when(other, off).when(~off, F.lit(False)).otherwise(s["disabled"])
        r = F.when(recall, off).when(other & ~off, F.lit(False)).when(extract & ~off & s["disabled"], F.lit(True)).otherwise(s["recall_disabled"])
        x = F.when(extract, off).when(other & ~off, F.lit(False)).when(recall & ~off & s["disabled"], F.lit(True)).otherwise(s["extract_disabled"])
        return F.struct(disabled.alias("disabled"), r.alias("recall_disabled"), x.alias("extract_disabled"))

    start = F.struct(*[F.lit(False).alias(c) for c in ("disabled", "recall_disabled", "extract_disabled")])
    events = F.array_sort(F.collect_list(F.struct("seq", "action", "target")))
    return log.groupBy("session_key").agg(F.aggregate(events, start, step).alias("s")).select("session_key", "s.*")


def eligible(config: Config, key: Column, provider: Column) -> Column:
    kind, chat = T.chat_type(key, provider), T.conversation_id(key)
    ok = F.coalesce(kind.isin(*config.allowed_chat_types), F.lit(False)) & F.lit(config.enabled)
    if config.denied_chat_ids:
        ok = ok & ~F.coalesce(chat.isin(*config.denied_chat_ids), F.lit(False))
    if config.allowed_chat_ids:
        ok = ok & F.coalesce(chat.isin(*config.allowed_chat_ids), F.lit(False))
    return ok


def circuit(log: DataFrame, now_ms: int, config: Config = Config()) -> DataFrame:
    """log: session_key, at, outcome (timeout or ok). open: enough timeouts in a row, the last one
    within the cool-down, no gap as long as it."""
    w = Window.partitionBy("session_key").orderBy("at")
    ok = F.sum((F.col("outcome") != "timeout").cast("int")).over(w)
    rows = log.withColumn("_run", ok).filter("outcome = 'timeout'")
    fresh = F.col("at") - F.lag("at").over(Window.partitionBy("session_key", "_run").orderBy("at")) >= config.breaker_cooldown_ms
    rows = rows.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(0))).withColumn("_part", F.sum("_new").over(Window.partitionBy("session_key", "_run").orderBy("at")))
    runs = rows.groupBy("session_key", "_run", "_part").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    latest = runs.groupBy("session_key").agg(F.max(F.struct("_run", "_part", "n", "last")).alias("r"))
    ends = log.groupBy("session_key").agg(F.max_by("outcome", "at").alias("_end"))
    j = ends.join(latest, "session_key", "left")
    is_open = (F.col("_end") == "timeout") & (F.col("r.n") >= config.breaker_max_timeouts) & (F.lit(now_ms) - F.col("r.last") < config.breaker_cooldown_ms)
    return j.select("session_key", F.coalesce(is_open, F.lit(False)).alias("open"))


def staged(indexes: DataFrame, prompts: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """indexes: session_id, prompt_hash, xml, at; prompts: session_id, prompt, at. Each prompt gets the
    newest index staged for it that hasn't expired; an index serves one prompt, the first."""
    p = prompts.withColumn("prompt_hash", T.prompt_hash(F.col("prompt"))).withColumnRenamed("at", "asked")
    j = indexes.join(p, ["session_id", "prompt_hash"]).filter((F.col("asked") >= F.col("at")) & (F.col("asked") - F.col("at") < ttl_ms))
    first = F.row_number().over(Window.partitionBy("session_id", "prompt_hash", "at").orderBy("asked"))
    j = j.withColumn("_n", first).filter("_n = 1").drop("_n")
    newest = F.row_number().over(Window.partitionBy("session_id", "prompt_hash", "asked").orderBy(F.desc("at")))
    return j.withColumn("_n", newest).filter("_n = 1").drop("_n")


def aliased(state: DataFrame, parent: str, child: str) -> DataFrame:
    """State (session_key, ...) with the parent's rows copied to the child."""
    copy = state.filter(F.col("session_key") == parent).withColumn("session_key", F.lit(child))
    return state.filter(F.col("session_key") != child).unionByName(copy)


def without_session(state: DataFrame, key: str) -> DataFrame:
    """State without the session's own and prefixed keys."""
    return state.filter((F.col("session_key") != key) & ~F.col("session_key").startswith(key + ":"))


class Cache:
    """Results by key for a while; the oldest entries go first. Driver-side."""

    def __init__(self, ttl_ms: int, most: int = 1000):
        self.ttl_ms, self.most, self.entries = ttl_ms, most, {}

    def get(self, key: str, now_ms: int) -> Any:
        at = self.entries.get(key)
        if at is None or at[0] <= now_ms:
            self.entries.pop(key, None)
            return None
        return at[1]

    def put(self, key: str, value: Any, now_ms: int) -> None:
        if self.ttl_ms > 0:
            self.entries[key] = (now_ms + self.ttl_ms, value)
            while len(self.entries) > self.most:
                del self.entries[next(iter(self.entries))]


class Circuit:
    """Which keys rest after too many timeouts in a row, and until when. Driver-side."""

    def __init__(self, max_timeouts: int, cooldown_ms: int, most: int = 1000):
        self.max_timeouts, self.cooldown_ms, self.most, self.keys = max_timeouts, cooldown_ms, most, {}

    def rests(self, key: str, now_ms: int) -> bool:
        n, until = self.keys.get(key, (0, 0))
        if until and until <= now_ms:
            del self.keys[key]
        return until > now_ms

    def timed_out(self, key: str, now_ms: int) -> None:
        n = self.keys.pop(key, (0, 0))[0] + 1
        self.keys[key] = (n, now_ms + self.cooldown_ms if n >= self.max_timeouts else 0)
        while len(self.keys) > self.most:
            del self.keys[next(iter(self.keys))]

    def answered(self, key: str) -> None:
        self.keys.pop(key, None)


def with_deadline(spark: SparkSession, seconds: float, work: Callable[[], Any]) -> Any:
    """work() within a job group that is cancelled at the deadline; TimeoutError then."""
    import threading
    import uuid

    group, late = uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "deadline", True)
    timer.start()
    try:
        return work()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds} s") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def retried(call: Callable[[], Any], pause: Callable[[float], None], tries: int = 3) -> Any:
    """call() again after a busy answer (429, 500, 502, 503, 529: 1, 2, 4 s) or a lost connection
    (1, 2, 3 s)."""
    for k in range(tries + 1):
        try:
            return call()
        except ConnectionError:
            if k == tries:
                raise
            pause(k + 1)
        except Exception as error:
            if k == tries or getattr(error, "status", None) not in (429, 500, 502, 503, 529):
                raise
            pause(2**k)
    return None
