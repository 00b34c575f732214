"""Reads, filters and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access as A
from tessera.operators import mutate as M
from tessera.queries import query
from tessera.sources import schemas
from tessera.sources.fixtures import NOW_MS

N = ["id", "type", "name", "status", "updated_at"]
_N = ", ".join(N)
_SESSIONS = "json_extract_string(source_sessions::json, '$[*]')"
_FLAGS = "coalesce(try_cast(case when json_valid(flags) and flags[1] = '[' then flags end as json)::varchar[], [])"


@query("a02_find_by_name", "select id, name from fx_nodes where name = 'doc-7'")
def _(fx):
    return A.by_name(fx.nodes, " Doc_7 ").select("id", "name")


@query("a03_find_by_id", f"select {_N} from fx_nodes where id = 'n00000007'")
def _(fx):
    return A.by_id(fx.nodes, "n00000007").select(*N)


@query("a04_active_nodes", f"select {_N} from fx_nodes where status = 'active'")
def _(fx):
    return A.active(fx.nodes).select(*N)


@query("a05_all_edges", "select * from fx_edges")
def _(fx):
    return fx.edges


@query("a06_edges_of_node", "select 'out' as side, id from fx_edges where from_id = 'n00000010' union all select 'in', id from fx_edges where to_id = 'n00000010'")
def _(fx):
    return A.edges_from(fx.edges, "n00000010").select(F.lit("out").alias("side"), "id").unionAll(A.edges_to(fx.edges, "n00000010").select(F.lit("in").alias("side"), "id"))


@query("a07_induced_edges", "select e.* from fx_edges e where from_id in (select id from fx_nodes where type in ('TASK', 'SKILL', 'EVENT')) and to_id in (select id from fx_nodes where type in ('TASK', 'SKILL', 'EVENT'))")
def _(fx):
    return A.induced_edges(fx.edges, fx.nodes.filter("type in ('TASK', 'SKILL', 'EVENT')"))


@query("a08_nodes_of_session", f"select {_N} from fx_nodes where status = 'active' and list_contains({_SESSIONS}, 's3')")
def _(fx):
    return A.of_session(fx.nodes, "s3").select(*N)


@query("a09_hot_nodes", f"select id, flags from fx_nodes where status = 'active' and list_contains({_FLAGS}, 'hot')")
def _(fx):
    return A.hot(fx.nodes).select("id", "flags")


@query("a10_scope_hot_nodes", f"select id, flags from fx_nodes where status = 'active' and list_has_any({_FLAGS}, ['scope_hot:click', 'scope_hot:view'])")
def _(fx):
    return A.scope_hot(fx.nodes, ["click", "view"]).select("id", "flags")


@query("a11_topics", "select id, name from fx_nodes where status = 'active' and type = 'TOPIC'")
def _(fx):
    return A.topics(fx.nodes).select("id", "name")


@query("a12_topic_edges", "select e.id from fx_edges e join fx_nodes a on e.from_id = a.id join fx_nodes b on e.to_id = b.id where a.type = 'TOPIC' and b.type = 'TOPIC' and a.status = 'active' and b.status = 'active'")
def _(fx):
    return A.topic_edges(fx.nodes, fx.edges).select("id")


@query("a13_semantic_topic_edges", "select e.id from fx_edges e join fx_nodes a on e.from_id = a.id join fx_nodes b on e.to_id = b.id where a.type <> 'TOPIC' and b.type = 'TOPIC' and a.status = 'active' and b.status = 'active'")
def _(fx):
    return A.semantic_topic_edges(fx.nodes, fx.edges).select("id")


@query("a14_node_info", """select n.id, n.name, n.status, (select count(*) from fx_edges e where e.from_id = n.id) as n_out, (select count(*) from fx_edges e where e.to_id = n.id) as n_in,
  (select least(count(*), 20) from fx_belief_signals b where b.node_id = n.id) as n_signals from fx_nodes n""")
def _(fx):
    return A.node_card(fx.nodes, fx.edges, fx.belief_signals)


@query("a15_stats", f"""select 'nodes' as what, '' as key, count(*) as n from fx_nodes where status = 'active' union all select 'type', type, count(*) from fx_nodes where status = 'active' group by type
  union all select 'hot', '', count(*) from fx_nodes where status = 'active' and list_contains({_FLAGS}, 'hot') union all select 'edges', '', count(*) from fx_edges union all select 'edge_name', name, count(*) from fx_edges group by name""")
def _(fx):
    return A.stats(fx.nodes, fx.edges)


@query("a16_belief_stats", "select round(avg(belief), 6) as avg_belief, count(*) filter (belief > 0.7) as n_high, count(*) filter (belief < 0.3) as n_low, (select count(*) from fx_belief_signals) as n_signals from fx_nodes where status = 'active'")
def _(fx):
    return A.belief_stats(fx.nodes, fx.belief_signals).withColumn("avg_belief", F.round("avg_belief", 6))


_TOP = "from fx_nodes where status = 'active' order by pagerank desc, validated_count desc, updated_at desc, id limit"


@query("a17_top_nodes", f"select id, round(pagerank, 6) as pagerank, validated_count {_TOP} 6")
def _(fx):
    return A.top_nodes(fx.nodes).select("id", F.round("pagerank", 6).alias("pagerank"), "validated_count")


@query("a18_graph_summary", f"select string_agg(format('[{{}}] {{}} (pr={{:.4f}}): {{}}', type, name, pagerank, description), chr(10) order by pagerank desc, validated_count desc, updated_at desc, id) as text from (select * {_TOP} 20)")
def _(fx):
    return A.graph_summary(fx.nodes)


@query("a19_recalled_at_turn", "select id, node_id, tier, round(coalesce(semantic, 0), 6) as semantic from fx_recalled where session_id = 's5' and turn_index = 3")
def _(fx):
    return A.recalled_at(fx.recalled, "s5", 3).select("id", "node_id", "tier", F.round("semantic", 6).alias("semantic"))


@query("a20_recently_recalled", f"""with pool as (select * from fx_recalled where created_at >= {NOW_MS} - 168 * 3600000 order by created_at desc, id limit 50)
  select id, node_id, created_at from (select *, row_number() over (partition by node_id order by created_at desc, id) as n from pool) where n = 1""")
def _(fx):
    return A.recently_recalled(fx.recalled, fx.now).select("id", "node_id", "created_at")


@query("a21_recently_created", f"select id, created_at from fx_nodes where status = 'active' and created_at >= {NOW_MS} - 2592000000 order by created_at desc, id limit 50")
def _(fx):
    return A.recently_created(fx.nodes, fx.now, 720).select("id", "created_at")


@query("a22_stale_candidates", f"""select id, last_accessed_at, round(belief * 0.3, 6) as composite from fx_nodes where status = 'active' and (last_accessed_at < {NOW_MS} - 10 * 86400000 or last_accessed_at = 0)
  and (type in ('STATUS', 'TASK') or belief < 0.5) order by last_accessed_at, id limit 100""")
def _(fx):
    return A.stale_candidates(fx.nodes, fx.now, 10).select("id", "last_accessed_at", F.round("composite", 6).alias("composite"))


@query("a23_belief_history", "select id, signal_type, created_at from fx_belief_signals where node_id = 'n00000017' order by created_at desc, id limit 20")
def _(fx):
    return A.belief_history(fx.belief_signals, "n00000017").select("id", "signal_type", "created_at")


@query("a24_belief_info", "select id, round(belief, 6) as belief, success_count, failure_count from fx_nodes where id = 'n00000005'")
def _(fx):
    return A.belief_info(A.by_id(fx.nodes, "n00000005")).withColumn("belief", F.round("belief", 6))


@query("a25_vector_hash", "select node_id, content_hash from fx_vectors where node_id = 'n00000003'")
def _(fx):
    return A.vector_hash(fx.vectors, "n00000003")


@query("a26_flags", "select name, flags from fx_nodes where name = 'doc-5'")
def _(fx):
    return A.flags_of(fx.nodes, "doc-5")


@query("p01_set_scopes", f"""select scope_name, session_id, created_at from fx_scopes where session_id <> (select min(session_id) from fx_scopes) union all
  select s, (select min(session_id) from fx_scopes), {NOW_MS} from (values ('alpha'), ('beta')) t(s)""")
def _(fx):
    scopes = fx.scopes
    first = scopes.agg(F.min("session_id")).first()[0]
    return M.set_scopes(scopes, first, fx.spark.createDataFrame([(" alpha ",), ("beta",), ("",), ("alpha",)], "scope_name string"), fx.now)


@query("p02_get_scopes", "select scope_name from fx_scopes where session_id = 's7' order by scope_name")
def _(fx):
    return A.scopes_of(fx.scopes, "s7").select("scope_name")


@query("p03_list_scopes", "select scope_name, count(*) as n from fx_scopes group by scope_name")
def _(fx):
    return A.list_scopes(fx.scopes)


@query("z04_migrated_edges", """select id, case name when 'uses' then '使用' when 'depends' then '依赖' end as name, description from fx_edges""")
def _(fx):
    old = fx.edges.select("id", F.when(F.col("name") == "uses", "USED_SKILL").otherwise("REQUIRES").alias("type"), F.col("description").alias("instruction"))
    return schemas.migrated_edges(old).select("id", "name", "description")
