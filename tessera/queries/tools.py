"""The engine's own requests, each on a store of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.engine import Engine
from tessera.queries import query
from tessera.sources.config import Config, clamp, names
from tessera.sources.schemas import TABLES
from tessera.sources.snapshots import Store, scratch_dir


def engine(fx, *tables: str, **more) -> Engine:
    """With nodes and edges, or the tables named."""
    e = Engine(fx.spark, f"{scratch_dir(fx.spark)}/tessera/store-{uuid.uuid4().hex}", lambda: fx.now, **more)
    e.store.commit({t: getattr(fx, t) for t in tables or ("nodes", "edges")})
    return e


@query("a01_store", "select 'nodes' as what, id from fx_nodes union all select 'edges', id from fx_edges")
def _(fx):
    """Tables written and opened again by another store."""
    e = engine(fx)
    again = Store(fx.spark, e.root, TABLES)
    return again.read("nodes").select(F.lit("nodes").alias("what"), "id").unionByName(again.read("edges").select(F.lit("edges").alias("what"), "id"))


@query("m10_merge_tool", """select id, case when name = 'doc-8' then 'deprecated' else status end as status, validated_count + case when name = 'doc-3' then (select validated_count from fx_nodes where name = 'doc-8') else 0 end as validated_count from fx_nodes""")
def _(fx):
    e = engine(fx)
    e.merge("Doc 3", "doc_8")
    return e.table("nodes").select("id", "status", "validated_count")


@query("m12_edit_tool", "select id, case when name = 'doc-5' then 'EVENT' else type end as type, case when name = 'doc-5' then 'new words' else description end as description, content from fx_nodes")
def _(fx):
    e = engine(fx, "nodes")
    e.edit_node("doc 5", description="new words", node_type="EVENT")
    return e.table("nodes").select("id", "type", "description", "content")


@query("s21_normalized_lists", "select * from (values ('a', 'b,a', 7), ('b', '', 5), ('c', '', 9), ('d', '', 0), ('e', '', 5)) v(id, names, number)")
def _(fx):
    rows = [("a", names([" B", "a", 3, "b "]), clamp("7.9", 5, 0, 9)), ("b", names("x"), clamp("x", 5, 0, 9)), ("c", names([]), clamp(12, 5, 0, 9)), ("d", names(None), clamp(-3.5, 5, 0, 9)), ("e", names([""]), clamp(float("nan"), 5, 0, 9))]
    return fx.spark.createDataFrame([(k, ",".join(n), v) for k, n, v in rows], "id string, names string, number int")


@query("e18_config", "select 50 as recall_timeout_ms, 7 as dedup_max_pairs, 3 as breaker_max_timeouts, false as enabled, 'a' as denied")
def _(fx):
    c = Config.of({"recall_timeout_ms": 1, "dedup_max_pairs": "7.9", "breaker_max_timeouts": "x", "enabled": False, "denied_chat_ids": [" A ", "a", 3]})
    return fx.spark.createDataFrame([(c.recall_timeout_ms, c.dedup_max_pairs, c.breaker_max_timeouts, c.enabled, ",".join(c.denied_chat_ids))], "recall_timeout_ms int, dedup_max_pairs int, breaker_max_timeouts int, enabled boolean, denied string")


_ANSWER = '{"nodes":[{"type":"SKILL","name":"Doc 3","description":"d","content":"c"},{"type":"task","name":"Quite New","content":"x"}],"edges":[{"from":"Quite New","to":"Doc 3","name":"helps","description":"much"}],"beliefUpdates":[{"nodeName":"doc-3","verdict":"contradicted","weight":1,"reason":"r"}]}'


@query("x03_record_tool", """select 'node' as what, name as a, cast(validated_count + case when name = 'doc-3' then 1 else 0 end as string) as b from fx_nodes union all select 'node', 'quite-new', '1' union all select 'edge', 'quite-new', 'doc-3' union all select 'signal', 'doc-3', 'contradicted'""")
def _(fx):
    """A model's answer to nodes, edges, and a logged and applied verdict."""
    e = engine(fx, complete=lambda system, prompt: f"Here: {_ANSWER}")
    e.record_text("s1", "system", "prompt")
    n = e.table("nodes").select("id", "name", "validated_count")
    by_id = n.select("id", "name")
    edges = e.table("edges").filter("name = 'helps'").join(by_id.toDF("from_id", "a"), "from_id").join(by_id.toDF("to_id", "b"), "to_id").select(F.lit("edge").alias("what"), "a", "b")
    signals = e.table("belief_signals").join(by_id.toDF("node_id", "a"), "node_id").select(F.lit("signal").alias("what"), "a", F.col("signal_type").alias("b"))
    return n.select(F.lit("node").alias("what"), F.col("name").alias("a"), F.col("validated_count").cast("string").alias("b")).unionByName(edges).unionByName(signals)


_TOPICS = '{"nodes":[{"name":"All Of It","description":"all"}],"edges":[{"from":"Doc 3","to":"All Of It","name":"主题属于","description":"d"},{"from":"All Of It","to":"Doc 3","name":"主题属于","description":"d"}]}'


@query("x12_topics_tool", "select 'all-of-it' as topic, 'TOPIC' as type, 'doc-3' as member, '主题属于' as name")
def _(fx):
    """The model's topics for two nodes; of its edges, the allowed one."""
    e = engine(fx, complete=lambda system, prompt: _TOPICS)
    e.induce_topics(["Doc 3", "doc-4"])
    n = e.table("nodes").filter("name in ('all-of-it', 'doc-3')").select("id", "name", "type")
    made = e.table("edges").filter("name = '主题属于'")
    topics = made.join(n.toDF("to_id", "topic", "type"), "to_id").join(n.drop("type").toDF("from_id", "member"), "from_id")
    return topics.select("topic", "type", "member", "name")


@query("e12_session_end", """with own as (select id, type from fx_nodes where status = 'active' and list_contains(json_extract_string(source_sessions::json, '$[*]'), 's7'))
  select 'session' as what, 'session-s7' as a, count(*) as n from own where id <> 'n00000007' and type <> 'SESSION' union all select 'signals', 'supported', count(*) from own where id <> 'n00000007' union all select 'skill', 'cache-well', 1""")
def _(fx):
    """Finalizing invalidates one node and adds a skill; then the session's node and its links."""
    e = engine(fx)
    final = fx.spark.createDataFrame([('{"promotedSkills":[{"name":"Cache well","content":"c"}],"newEdges":[],"invalidations":["n00000007"]}', 0)], "raw string, seq int")
    summary = fx.spark.createDataFrame([('{"description":"d","summary":"s"}', 0)], "raw string, seq int")
    e.finalize("s7", final)
    e.induce_session("s7", summary)
    n, edges, signals = e.table("nodes"), e.table("edges"), e.table("belief_signals")
    known = fx.nodes.select("id")
    session = n.filter("type = 'SESSION' and name = 'session-s7'").select(F.col("id").alias("to_id"), F.col("name").alias("a"))
    links = edges.filter("name = '属于会话'").join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(session, "to_id").groupBy("a").agg(F.count("*").alias("n")).select(F.lit("session").alias("what"), "a", "n")
    logged = signals.join(known.withColumnRenamed("id", "node_id"), "node_id", "left_semi").groupBy(F.col("signal_type").alias("a")).agg(F.count("*").alias("n")).select(F.lit("signals").alias("what"), "a", "n")
    skill = n.filter("name = 'cache-well' and status = 'active'").groupBy(F.col("name").alias("a")).agg(F.count("*").alias("n")).select(F.lit("skill").alias("what"), "a", "n")
    return links.unionByName(logged).unionByName(skill)
