"""Changes: tables after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access as A
from tessera.operators import mutate as M
from tessera.queries import query
from tessera.queries.access import _FLAGS, _SESSIONS
from tessera.sources.fixtures import NOW_MS


def _incoming(fx):
    """Known and new names, some twice."""
    d = fx.table("documents").select((F.col("doc_id") % 60).alias("k"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    name = F.when(F.col("k") < 40, F.concat(F.lit("Doc_"), F.col("k"))).otherwise(F.concat(F.lit("new "), F.col("k")))
    return d.select(name.alias("name"), F.lit("SKILL").alias("type"), F.concat(F.lit("d"), F.col("seq")).alias("description"), "content", F.concat(F.lit("s"), F.col("seq") % 3).alias("session_id"), F.array(F.when(F.col("seq") % 2 == 0, "hot").otherwise("x")).alias("flags"), "seq")


@query("m01_upsert_nodes", f"""with i as (select case when doc_id % 60 < 40 then concat('doc-', doc_id % 60) else concat('new-', doc_id % 60) end as name, doc_id as seq, concat('d', doc_id) as d from documents),
  f as (select name, count(*) as c, arg_max(d, seq) as d from i group by name)
  select coalesce(n.name, f.name) as name, coalesce(n.type, 'SKILL') as type, coalesce(f.d, n.description) as description, case when f.c is not null then 'active' else n.status end as status,
    coalesce(n.validated_count, 0) + coalesce(f.c, 0) as validated_count, case when f.c is not null then {NOW_MS} else n.updated_at end as updated_at from fx_nodes n full join f on n.name = f.name""")
def _(fx):
    return M.upsert_nodes(fx.nodes, _incoming(fx), fx.now).select("name", "type", "description", "status", "validated_count", "updated_at")


@query("m01_upsert_sets", f"""with i as (select case when doc_id % 60 < 40 then concat('doc-', doc_id % 60) else concat('new-', doc_id % 60) end as name, concat('s', doc_id % 3) as s, case when doc_id % 2 = 0 then 'hot' else 'x' end as f from documents),
  u as (select name, list_distinct(list(s)) as s, list_distinct(list(f)) as f from i group by name)
  select coalesce(n.name, u.name) as name, list_sort(list_distinct(list_concat(coalesce({_SESSIONS}, []), coalesce(u.s, [])))) as sessions, list_sort(list_distinct(list_concat({_FLAGS}, coalesce(u.f, [])))) as flags from fx_nodes n full join u on n.name = u.name""")
def _(fx):
    """Of every node, touched or not; flags that are no list count as none."""
    out = M.upsert_nodes(fx.nodes, _incoming(fx), fx.now)
    return out.select("name", F.array_sort("source_sessions").alias("sessions"), F.array_sort(A.flag_list(F.col("flags"))).alias("flags"))


@query("m02_deprecate", "select id, case when type = 'EVENT' then 'deprecated' else status end as status from fx_nodes")
def _(fx):
    return M.deprecate(fx.nodes, fx.nodes.filter("type = 'EVENT'"), fx.now).select("id", "status")


@query("m03_set_flags", "select id, case when type = 'TASK' then '[\"a\",\"b\"]' else flags end as flags, case when type = 'TASK' then 'active' else status end as status from fx_nodes")
def _(fx):
    new = fx.nodes.filter("type = 'TASK'").select("id", F.array(F.lit("a"), F.lit("b")).alias("new_flags"))
    return M.set_flags(fx.nodes, new, fx.now).select("id", "flags", "status")


def _merges(fx):
    return fx.nodes.filter("cast(substr(id, 2) as int) % 10 = 4").select(F.col("id").alias("merge_id"), F.concat(F.substring("id", 1, 8), F.lit("0")).alias("keep_id"))


@query("m04_merge_nodes", """with m as (select id as merge_id, concat(substr(id, 1, 8), '0') as keep_id from fx_nodes where cast(substr(id, 2) as int) % 10 = 4)
  select k.id, case when k.id in (select merge_id from m) then 'deprecated' else k.status end as status, k.validated_count + coalesce(l.validated_count, 0) as validated_count,
    round(k.success_count + coalesce(l.success_count, 0), 6) as success_count, round(k.failure_count + coalesce(l.failure_count, 0), 6) as failure_count,
    case when length(l.content) > length(k.content) then l.content else k.content end as content,
    round(case when l.id is not null and k.success_count + l.success_count + k.failure_count + l.failure_count > 0 then (1 + k.success_count + l.success_count) / (2 + k.success_count + l.success_count + k.failure_count + l.failure_count) else k.belief end, 6) as belief
  from fx_nodes k left join m on m.keep_id = k.id left join fx_nodes l on l.id = m.merge_id""")
def _(fx):
    r = lambda c: F.round(c, 6).alias(c)
    return M.merged_nodes(fx.nodes, _merges(fx), fx.now).select("id", "status", "validated_count", r("success_count"), r("failure_count"), "content", r("belief"))


@query("m04_merge_edges", """with e as (select id, case when cast(substr(from_id, 2) as int) % 10 = 4 and from_id in (select id from fx_nodes) then concat(substr(from_id, 1, 8), '0') else from_id end as from_id,
    case when cast(substr(to_id, 2) as int) % 10 = 4 and to_id in (select id from fx_nodes) then concat(substr(to_id, 1, 8), '0') else to_id end as to_id, name, description from fx_edges)
  select min(id) as id, from_id, to_id, name, arg_min(description, id) as description from e where from_id <> to_id group by from_id, to_id, name""")
def _(fx):
    return M.merged_edges(fx.edges, _merges(fx)).select("id", "from_id", "to_id", "name", "description")


@query("m05_set_pageranks", "select id, round(case when status = 'active' and type = 'TASK' then 0.5 else pagerank end, 6) as pagerank from fx_nodes")
def _(fx):
    scores = fx.nodes.filter("type = 'TASK'").select("id", F.lit(0.5).alias("score"))
    return M.set_pageranks(fx.nodes, scores).select("id", F.round("pagerank", 6).alias("pagerank"))


@query("m06_upsert_edges", """with i as (select from_id, to_id, name, concat('new ', id) as d, id as seq from fx_edges where name = 'depends' union all select to_id, from_id, 'back', concat('back ', id), id from fx_edges where name = 'depends'),
  ok as (select * from i where from_id in (select id from fx_nodes where status = 'active') and to_id in (select id from fx_nodes where status = 'active')),
  f as (select from_id, to_id, name, arg_max(d, seq) as d from ok group by from_id, to_id, name)
  select coalesce(e.from_id, f.from_id) as from_id, coalesce(e.to_id, f.to_id) as to_id, coalesce(e.name, f.name) as name, coalesce(f.d, e.description) as description
  from fx_edges e full join f on e.from_id = f.from_id and e.to_id = f.to_id and e.name = f.name""")
def _(fx):
    e = fx.edges.filter("name = 'depends'")
    rows = e.select("from_id", "to_id", "name", F.concat(F.lit("new "), "id").alias("description"), "session_id", F.col("id").alias("seq"))
    back = e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("back").alias("name"), F.concat(F.lit("back "), "id").alias("description"), "session_id", F.col("id").alias("seq"))
    return M.upsert_edges(fx.edges, rows.unionByName(back), fx.nodes, fx.now).select("from_id", "to_id", "name", "description")


@query("m07_update_fields", "select id, case when type = 'EVENT' then 'changed' else description end as description, case when type = 'EVENT' then 'STATUS' else type end as type from fx_nodes")
def _(fx):
    s = lambda v: F.lit(v).cast("string")
    new = fx.nodes.filter("type = 'EVENT'").select("id", s("changed").alias("new_description"), s(None).alias("new_content"), s("STATUS").alias("new_type"))
    bad = fx.nodes.filter("type = 'TASK'").select("id", s("x").alias("new_description"), s(None).alias("new_content"), s("NO_TYPE").alias("new_type"))
    return M.update_fields(fx.nodes, new.unionByName(bad), fx.now).select("id", "description", "type")


@query("m08_record_access", f"select n.id, n.access_count + coalesce(c, 0) as access_count, case when c > 0 then {NOW_MS} else last_accessed_at end as last_accessed_at from fx_nodes n left join (select node_id, count(*) as c from fx_recalled where tier = 'L1' group by node_id) r on r.node_id = n.id")
def _(fx):
    return M.record_access(fx.nodes, fx.recalled.filter("tier = 'L1'").select(F.col("node_id").alias("id")), fx.now).select("id", "access_count", "last_accessed_at")


@query("m09_remove", "with g as (select id from fx_nodes where type = 'STATUS' and status = 'active') select 'node' as kind, id from fx_nodes where status = 'active' and id not in (select id from g) union all select 'edge', id from fx_edges where from_id not in (select id from g) and to_id not in (select id from g)")
def _(fx):
    nodes, edges = M.removed(fx.nodes, fx.edges, fx.nodes.filter("type = 'STATUS'"), fx.now)
    return nodes.filter("status = 'active'").select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id"))


@query("m11_add_hot", f"select id, list_sort(list_distinct(list_concat({_FLAGS}, case when type = 'TASK' then ['hot'] else [] end))) as flags from fx_nodes")
def _(fx):
    from tessera.operators.access import flag_list

    return M.add_flag(fx.nodes, fx.nodes.filter("type = 'TASK'"), "hot", fx.now).select("id", F.array_sort(flag_list(F.col("flags"))).alias("flags"))


@query("m13_session_links", "select n.id as from_id, s.id as to_id from fx_nodes n join fx_nodes s on s.type = 'SESSION' and json_extract_string(s.source_sessions::json, '$[0]') = json_extract_string(n.source_sessions::json, '$[0]') and n.id <> s.id where n.type = 'TASK'")
def _(fx):
    first = fx.nodes.withColumn("session_id", F.get("source_sessions", 0))
    return M.session_links(first.filter("type = 'TASK'"), first.filter("type = 'SESSION'")).select("from_id", "to_id")


@query("m14_finalize", "select 'node' as kind, name as key from fx_nodes where status = 'active' and type <> 'STATUS' union select 'node', 'fresh-skill' union all select 'edge', 'supports'")
def _(fx):
    live = fx.nodes.filter("status = 'active' and type <> 'STATUS'")
    skill = fx.spark.createDataFrame([("Fresh Skill", "x", "d", "c", "s1", 0)], "name string, type string, description string, content string, session_id string, seq int").withColumn("flags", F.array().cast("array<string>"))
    link = live.orderBy("id").limit(1).select(F.lit("fresh-skill").alias("from_name"), F.col("name").alias("to_name"), F.lit("supports").alias("name"), F.lit("d").alias("description"), F.lit("s1").alias("session_id"), F.lit(0).alias("seq"))
    nodes, edges = M.finalized(fx.nodes, fx.edges.limit(0), skill, link, fx.nodes.filter("type = 'STATUS'").select("id"), fx.now)
    return nodes.filter("status = 'active'").select(F.lit("node").alias("kind"), F.col("name").alias("key")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("name").alias("key")))


@query("b01_belief", "select id, round((1 + success_count) / (2 + success_count + failure_count), 6) as belief from fx_nodes")
def _(fx):
    from tessera.functions.scores import belief

    return fx.nodes.select("id", F.round(belief(F.col("success_count"), F.col("failure_count")), 6).alias("belief"))


@query("b02_append_signals", "select id from fx_belief_signals")
def _(fx):
    s = fx.belief_signals
    return M.appended(s.filter("signal_type = 'supported'"), s).select("id")


_SUMS = "(select node_id, sum(case when signal_type = 'supported' then weight else 0 end) as s, sum(case when signal_type = 'contradicted' then weight else 0 end) as f from fx_belief_signals group by node_id)"


@query("b03_apply_beliefs", f"""select n.id, round(success_count + coalesce(s, 0), 4) as success_count, round(failure_count + coalesce(f, 0), 4) as failure_count,
  round(case when s is null then belief else (1 + success_count + s) / (2 + success_count + s + failure_count + f) end, 6) as belief from fx_nodes n left join {_SUMS} x on x.node_id = n.id""")
def _(fx):
    return M.applied_beliefs(fx.nodes, fx.belief_signals).select("id", F.round("success_count", 4).alias("success_count"), F.round("failure_count", 4).alias("failure_count"), F.round("belief", 6).alias("belief"))


@query("b04_named_beliefs", "select id as node_id, 'supported' as signal_type from fx_nodes where name in ('doc-1', 'doc-2')")
def _(fx):
    updates = fx.spark.createDataFrame([("Doc_1", "supported", 1.0, "s1"), ("doc 2", "supported", 2.0, "s1"), ("nobody", "contradicted", 1.0, "s1")], "node_name string, verdict string, weight double, session_id string")
    return M.named_beliefs(fx.nodes, updates).select("node_id", "signal_type")


@query("b05_session_support", f"select id, round((1 + success_count + 1) / (2 + success_count + 1 + failure_count), 6) as belief from fx_nodes where status = 'active' and list_contains({_SESSIONS}, 's3')")
def _(fx):
    support = M.session_support(fx.nodes, "s3")
    return M.applied_beliefs(fx.nodes, support).join(support.select(F.col("node_id").alias("id")), "id", "left_semi").select("id", F.round("belief", 6).alias("belief"))
