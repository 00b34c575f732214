"""Streams, run over what is there, and folds of event logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.queries import query
from tessera.sources.config import Config
from tessera.sources.schemas import TABLES
from tessera.sources.snapshots import Store, scratch_dir
from tessera.streaming import sessions as S


def folder(fx) -> str:
    return f"{scratch_dir(fx.spark)}/tessera/stream-{uuid.uuid4().hex}"


def events(fx):
    return S.file_stream(fx.spark, fx.sf_dir, "events", fx.table("events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def gathered(fx, stream, mode: str = "complete"):
    """The stream's result after all its input: what its last batch wrote."""
    at = folder(fx)
    S.drained(stream, lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out"), f"{at}/state", mode)
    return fx.spark.read.parquet(f"{at}/out")


def messages(fx):
    schema = fx.table("conversations").schema
    session = F.concat_ws("", F.lit("s"), F.col("conv_id").cast("string"))  # without an id: s
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    return S.file_stream(fx.spark, fx.sf_dir, "conversations", schema).select(session.alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("seq"), place.alias("place"))


@query("e01_ingest", "select concat('s', conv_id) as session_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as turn_index, trim(text) as content from conversations")
def _(fx):
    store = Store(fx.spark, folder(fx), TABLES)
    S.ingest(messages(fx), store, folder(fx), lambda n: fx.now)
    return store.read("messages").select("session_id", "turn_index", "content")


@query("e03_turn_counts", "select concat('s', conv_id) as session_id, count(*) as turns, count(*) >= 3 as due from conversations group by conv_id")
def _(fx):
    return gathered(fx, S.turn_counts(messages(fx).select("session_id"), 3), "update")


@query("e14_tumbling", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(fx):
    return gathered(fx, S.tumbling(events(fx))).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("e14_sliding", "select start, count(*) as n from (select unnest([time_bucket(interval '3 hours', ts, timestamp '2024-01-01'), time_bucket(interval '3 hours', ts, timestamp '2024-01-01') - interval '3 hours']) as start from events) group by start")
def _(fx):
    return gathered(fx, S.sliding(events(fx))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("e14_user_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new) as k from g)
  select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k""")
def _(fx):
    found = gathered(fx, S.user_sessions(events(fx)))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("e14_first_seen", "select count(*) as n from (select distinct user_id, event_type from events)")
def _(fx):
    return gathered(fx, S.first_seen(events(fx).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "400 days"), "append").agg(F.count("*").alias("n"))


TOGGLES = [("a", 1, "off", "all"), ("a", 2, "on", "recall"), ("b", 1, "off", "all"), ("b", 2, "on", "extract"), ("c", 1, "off", "recall"), ("c", 2, "on", "all"), ("d", 1, "off", "extract")]


@query("e08_toggles", "select * from (values ('a', false, false, true), ('b', false, true, false), ('c', false, false, false), ('d', false, false, true)) v(session_key, disabled, recall_disabled, extract_disabled)")
def _(fx):
    return S.toggles(fx.spark.createDataFrame(TOGGLES, "session_key string, seq int, action string, target string"))


@query("e07_eligible", "select * from (values ('agent:m:direct:u1', true), ('agent:m:group:bad', false), ('agent:m:channel:c', false), ('', false)) v(k, ok)")
def _(fx):
    config = Config.of({"allowed_chat_types": ["direct", "group"], "denied_chat_ids": ["BAD "]})
    rows = fx.spark.createDataFrame([("agent:m:direct:u1",), ("agent:m:group:bad",), ("agent:m:channel:c",), ("",)], "k string")
    return rows.select("k", S.eligible(config, F.col("k"), F.lit(None).cast("string")).alias("ok"))


OUTCOMES = [("a", 1000, "timeout"), ("a", 2000, "timeout"), ("a", 3000, "timeout"), ("b", 1000, "timeout"), ("b", 2000, "ok"), ("b", 3000, "timeout"), ("c", 1000, "timeout"), ("c", 100000, "timeout"), ("c", 100001, "timeout"), ("d", 1, "ok")]


@query("e05_circuit", "select * from (values ('a', true), ('b', false), ('c', false), ('d', false)) v(session_key, open)")
def _(fx):
    return S.circuit(fx.spark.createDataFrame(OUTCOMES, "session_key string, at long, outcome string"), 50_000)


@query("e09_staged_index", "select * from (values ('s', 20, 'x2')) v(session_id, asked, xml)")
def _(fx):
    from tessera.functions.text import prompt_hash

    rows = fx.spark.createDataFrame([("s", "hi", "x1", 1), ("s", "hi", "x2", 5), ("s", "late", "x3", 1), ("t", "hi", "x4", 1)], "session_id string, p string, xml string, at int")
    prompts = fx.spark.createDataFrame([("s", "hi", 20), ("s", "late", 50_000), ("s", "other", 3)], "session_id string, prompt string, at int")
    return S.staged(rows.withColumn("prompt_hash", prompt_hash(F.col("p"))).drop("p"), prompts).select("session_id", "asked", "xml")


@query("e11_aliases", "select session_id as session_key, scope_name from fx_scopes where session_id <> 'child' union all select 'child', scope_name from fx_scopes where session_id = 's7'")
def _(fx):
    return S.aliased(fx.scopes.select(F.col("session_id").alias("session_key"), "scope_name"), "s7", "child")


@query("e17_cleanup", "select distinct session_id as session_key from fx_scopes where session_id <> 's7'")
def _(fx):
    return S.without_session(fx.scopes.select(F.col("session_id").alias("session_key")).distinct(), "s7")


@query("z03_snapshots", "select 'first' as version, count(*) as n from fx_scopes union all select 'second', count(*) from fx_scopes where scope_name <> 'view' union all select 'rolled back', count(*) from fx_scopes")
def _(fx):
    store = Store(fx.spark, folder(fx), TABLES)
    first = store.commit({"scopes": fx.scopes})["scopes"]
    count = lambda name: store.read("scopes").agg(F.lit(name).alias("version"), F.count("*").alias("n"))
    out = count("first")
    store.commit({"scopes": store.read("scopes").filter("scope_name <> 'view'")})
    out = out.unionByName(count("second"))
    store.roll_back("scopes", first)
    return out.unionByName(count("rolled back"))
