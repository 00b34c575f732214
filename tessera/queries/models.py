"""Answers of models: parsing and what follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extraction as X
from tessera.operators import mutate as M
from tessera.queries import query
from tessera.sources.config import BELONGS, CONTAINS

#: (id, answer, its JSON as an oracle can read it). The pieces that differ are fences, prose, thoughts
#: and a raw line break inside a string.
_A = '{"nodes":[{"type":"SKILL","name":"Use Redis","description":"cache","content":"run it"},{"type":"task","name":"Deploy_App","content":"ship"},{"type":"TOPIC","name":"no","content":"x"},{"type":"EVENT","name":"","content":"x"}],"edges":[{"from":"Use Redis","to":"Deploy_App","name":"helps","description":"much"},{"from":"a","to":"b","name":"","description":"x"}],"beliefUpdates":[{"nodeName":"Use Redis","verdict":"supported","weight":9.5,"reason":"ok"},{"nodeName":"x","verdict":"contradicted","weight":0.1,"reason":"r"}],"advisorySuggestions":[{"nodeName":"Use Redis","suggestion":"write docs","reason":"often asked","suggestedDocTitle":"Redis"}]}'
_B = '{"nodes":[{"type":"EVENT","name":"Crash","description":"d","content":"line one%sline two"}],"edges":[]}'
RAW = [("plain", _A, _A), ("fenced", f"```json\n{_A}\n```", _A), ("prose", f"Here you are: {_A} Bye.", _A), ("thought", "<think>{no}</think>" + _A, _A), ("break", _B % "\n", _B % "\\n"), ("empty", "{}", "{}"), ("garbage", "no json at all", None)]
_ROWS = ", ".join("('{}', {})".format(i, "null" if j is None else "'" + j.replace("'", "''") + "'") for i, _, j in RAW)
_SRC = f"(select id, j::json as j from (values {_ROWS}) v(id, j))"
_NAME = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[\s_]+', '-', 'g'), '[^a-z0-9一-鿿\-]', '', 'g'), '^-|-$', '', 'g')"


def name(path: str) -> str:
    return _NAME.format(c=path)


def answers(fx):
    return fx.spark.createDataFrame([(i, r) for i, r, _ in RAW], "id string, raw string")


@query("x01_extracted_nodes", f"select id, upper(n->>'type') as type, {name('''n->>'name' ''')} as name, coalesce(n->>'description', '') as description, n->>'content' as content from (select id, unnest(j->'nodes'->'$[*]') as n from {_SRC}) where coalesce(n->>'name', '') <> '' and upper(n->>'type') in ('TASK', 'SKILL', 'EVENT', 'KNOWLEDGE', 'STATUS')")
def _(fx):
    return X.extraction(answers(fx)).select("id", F.inline("nodes"))


@query("x01_extracted_edges", f"select id, {name('''e->>'from' ''')} as \"from\", {name('''e->>'to' ''')} as \"to\", e->>'name' as name, e->>'description' as description from (select id, unnest(j->'edges'->'$[*]') as e from {_SRC}) where e->>'name' <> ''")
def _(fx):
    return X.extraction(answers(fx)).select("id", F.inline("edges"))


@query("x01_extracted_beliefs", f"select id, {name('''b->>'nodeName' ''')} as node_name, b->>'verdict' as verdict, greatest(0.5, least(2.0, (b->>'weight')::double)) as weight from (select id, unnest(j->'beliefUpdates'->'$[*]') as b from {_SRC})")
def _(fx):
    return X.extraction(answers(fx)).select("id", F.inline("beliefs")).drop("reason")


@query("x01_errors", f"select id, j is null as error from {_SRC}")
def _(fx):
    return X.extraction(answers(fx)).select("id", "error")


_FIN = '{"promotedSkills":[{"name":"S","content":"c"},{"name":"","content":"c"}],"newEdges":[{"from":"A b","to":"C","name":"n","description":"d"}],"invalidations":["n1","n2"]}'


@query("x02_finalization", "select * from (values ('a', 1::bigint, 'a-b', 2::bigint), ('b', 0::bigint, null, 0::bigint)) v(id, n_skills, edge_from, n_invalid)")
def _(fx):
    rows = fx.spark.createDataFrame([("a", _FIN), ("b", "oops")], "id string, raw string")
    return X.finalization(rows).select("id", F.size("skills").cast("long").alias("n_skills"), F.try_element_at("edges", F.lit(1))["from"].alias("edge_from"), F.size("invalid").cast("long").alias("n_invalid"))


_IND = '{"nodes":[{"name":"Web Apps","description":" all  ","content":""},{"name":"web_apps","description":"again"},{"name":"x"}],"edges":[{"from":"a","to":"Web Apps","name":" in ","description":"d"},{"from":"A","to":"web-apps","name":"in","description":"e"}]}'


@query("x05_induction", "select * from (values ('node', 'web-apps', 'all', 'all'), ('edge', 'a', 'web-apps', 'in')) v(kind, a, b, c)")
def _(fx):
    p = X.induction(fx.spark.createDataFrame([("i", f"```\n{_IND}\n```")], "id string, raw string"))
    nodes = p.select(F.explode("nodes").alias("n")).select(F.lit("node").alias("kind"), F.col("n.name").alias("a"), F.col("n.description").alias("b"), F.col("n.content").alias("c"))
    return nodes.unionByName(p.select(F.explode("edges").alias("e")).select(F.lit("edge").alias("kind"), F.col("e.from").alias("a"), F.col("e.to").alias("b"), F.col("e.name").alias("c")))


@query("x07_allowed_edges", """with t as (select name, type from fx_nodes where status = 'active'), e as (select a.name as from_name, b.name as to_name, case when x.name = 'uses' then '主题属于' else '主题包含' end as name from fx_edges x join fx_nodes a on a.id = x.from_id join fx_nodes b on b.id = x.to_id)
  select e.* from e join t a on a.name = e.from_name join t b on b.name = e.to_name where (e.name = '主题属于' and a.type in ('TASK', 'SKILL', 'EVENT', 'KNOWLEDGE', 'STATUS') and b.type = 'TOPIC') or (e.name = '主题包含' and a.type = 'TOPIC' and b.type = 'TOPIC')""")
def _(fx):
    names = fx.nodes.select("id", "name")
    e = fx.edges.withColumn("name", F.when(F.col("name") == "uses", BELONGS).otherwise(CONTAINS))
    e = e.join(names.toDF("from_id", "from_name"), "from_id").join(names.toDF("to_id", "to_name"), "to_id").select("from_name", "to_name", "name")
    return X.allowed_edges(e, fx.nodes.filter("status = 'active'").select("name", "type"))


@query("x10_session_summary", "select * from (values ('a', 'short', 'long'), ('b', '', '')) v(id, description, summary)")
def _(fx):
    return X.session_summary(fx.spark.createDataFrame([("a", 'ok {"description":" short ","summary":"long"}'), ("b", "none")], "id string, raw string")).drop("raw")


@query("x09_session_node", "select name, type, validated_count from (values ('session-s1', 'SESSION', 2::bigint)) v(name, type, validated_count)")
def _(fx):
    p = X.session_summary(fx.spark.createDataFrame([('{"description":"d","summary":"s"}', 0), ('{"description":"e","summary":"t"}', 1)], "raw string, seq int"))
    rows = p.select(F.lit("session s1").alias("name"), F.lit("SESSION").alias("type"), "description", F.col("summary").alias("content"), F.lit("s1").alias("session_id"), F.array().cast("array<string>").alias("flags"), "seq")
    return M.upsert_nodes(fx.nodes.limit(0), rows, fx.now).filter("content = 't'").select("name", "type", "validated_count")


@query("x13_advice", "select 'use-redis' as node_name, 'write docs' as suggestion")
def _(fx):
    advice = X.extraction(answers(fx)).select(F.inline("advice"))
    return X.advice_for(fx.spark.createDataFrame([("use-redis",), ("other",)], "name string"), advice).select("node_name", "suggestion")


@query("x11_record", "select 'crash' as name, 1::bigint as validated_count union all select 'deploy-app', 4 union all select 'use-redis', 4")
def _(fx):
    """Answers to nodes: parsed, then upserted."""
    p = X.extraction(answers(fx).withColumn("seq", F.xxhash64("id"))).filter("not error")
    rows = p.select("seq", F.explode("nodes").alias("n")).select("seq", "n.*", F.lit("s1").alias("session_id"), F.array().cast("array<string>").alias("flags"))
    return M.upsert_nodes(fx.nodes.limit(0), rows, fx.now).select("name", "validated_count")


TRANSCRIPT = [
    ("s", 0, "user", None, None, False), ("s", 1, "assistant", ["c1", "c2"], None, False), ("s", 2, "toolResult", None, "c1", False), ("s", 3, "user", None, None, False), ("s", 4, "toolResult", None, "c1", False), ("s", 5, "toolResult", None, "zz", False),
    ("s", 6, "assistant", ["c3"], None, True), ("s", 7, "toolResult", None, "c3", False), ("s", 8, "assistant", None, None, False), ("t", 0, "toolResult", None, "c9", False), ("t", 1, "assistant", ["c9"], None, False), ("t", 2, "toolResult", None, "c9", False),
]


@query("f11_tool_pairs", """select * from (values ('s', 0, 'user', null, false), ('s', 1, 'assistant', null, false), ('s', 2, 'toolResult', 'c1', false), ('s', 3, 'toolResult', 'c2', true), ('s', 4, 'user', null, false), ('s', 5, 'assistant', null, false), ('s', 6, 'assistant', null, false),
  ('t', 0, 'assistant', null, false), ('t', 1, 'toolResult', 'c9', false)) v(session, ord, role, result_id, made)""")
def _(fx):
    rows = fx.spark.createDataFrame(TRANSCRIPT, "session string, pos int, role string, call_ids array<string>, result_id string, stopped boolean")
    return X.repaired(rows).drop("pos")
