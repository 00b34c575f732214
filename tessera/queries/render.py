"""Rendered contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access as A
from tessera.operators import ranking as K
from tessera.operators import rendering as R
from tessera.queries import query
from tessera.queries.access import _FLAGS

_E = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def e(c: str) -> str:
    return _E.format(c=c)


#: Thirty tiered nodes, and the SQL for them.
_T = "t as (select *, case when n <= 5 then 'L1' when n <= 10 then 'L2' when n <= 15 then 'L3' else 'filtered' end as tier, case when n <= 5 then 3 when n <= 10 then 2 else 1 end as pri from (select *, row_number() over (order by round(pagerank, 9) desc, id) as n from fx_nodes where status = 'active'))"


def tiered(fx):
    return K.tiered(A.active(fx.nodes).select("id", "type", "name", "description", "content", "belief", "pagerank", "updated_at", "last_accessed_at", "flags"), 15, "pagerank")


def attrs(confidence: bool, updated: bool, source: str = "'recalled'") -> str:
    parts = [f"concat(' source=\"', {source}, '\" tier=\"', lower(tier), '\"')"]
    if confidence:
        parts.append("format(' confidence=\"{:.2f}\"', round(belief, 2))")
    if updated:
        parts.append("concat(' updated=\"', strftime(make_timestamp(updated_at * 1000), '%Y-%m-%d'), '\"')")
    return "concat(" + ", ".join(parts) + ")"


def element(tail: str) -> str:
    head = f"concat('  <', lower(type), ' name=\"', {e('name')}, '\"')"
    desc = f"concat(' desc=\"', {e('description')}, '\"')"
    return f"case tier when 'L3' then concat({head}, {tail}, '/>') when 'L2' then concat({head}, {desc}, {tail}, '/>') else concat({head}, {desc}, {tail}, case when tier = 'scope_hot' then ' scope_hot=\"true\"' else '' end, '>', chr(10), {e('trim(content, E' + chr(39) + ' ' + chr(92) + 'n' + chr(92) + 't' + chr(92) + 'r' + chr(39) + ')')}, chr(10), '  </', lower(type), '>') end"


_EDGE = f"""x as (select d.id, d.name, d.from_id, d.to_id, concat('    <e name="', {e('d.name')}, '" from="', {e('a.name')}, '" to="', {e('b.name')}, '"', case when a.tier = 'L1' or b.tier = 'L1' then concat('>', {e('d.description')}, '</e>') else '/>' end) as line, a.tier as ta, b.tier as tb
  from fx_edges d join t a on a.id = d.from_id join t b on b.id = d.to_id where a.tier <> 'filtered' and b.tier <> 'filtered')"""
_INNER = "coalesce((select case when count(*) > 0 then concat(chr(10), '  <edges>', chr(10), string_agg(line, chr(10) order by {o}), chr(10), '  </edges>') end from x {w}), '')"


@query("f03_knowledge_graph", f"with {_T}, {_EDGE} select concat('<knowledge_graph>', chr(10), string_agg({element(attrs(True, True))}, chr(10) order by -pri, type, name, id), any_value({_INNER.format(o='name, from_id, to_id, id', w='')}), chr(10), '</knowledge_graph>') as xml from t where tier <> 'filtered'")
def _(fx):
    return R.knowledge_graph(tiered(fx), fx.edges).select("xml")


_S = f"t as (select id, type, name, description, content, belief, updated_at, case when list_has_any({_FLAGS}, ['scope_hot:click', 'scope_hot:view']) then 'scope_hot' when list_contains({_FLAGS}, 'hot') then 'hot' when type = 'TASK' then 'active' end as tier from fx_nodes where status = 'active')"


def sources(fx):
    nodes = fx.nodes.select("id", "type", "name", "description", "content", "belief", "pagerank", "updated_at", "flags", "status")
    return A.scope_hot(nodes, ["click", "view"]), A.hot(nodes), A.active(nodes).filter("type = 'TASK'")


@query("f01_merged_tiers", f"with {_S} select id, tier from t where tier is not null")
def _(fx):
    s, h, a = sources(fx)
    return R.merged_tiers(s, h, s.withColumn("tier", F.lit("L1")).limit(3), a).select("id", "tier")


@query("f02_merged_edges", "select id from fx_edges")
def _(fx):
    return R.merged_edges(fx.edges.filter("name = 'uses'"), fx.edges).select("id")


@query("f04_stable_context", f"with {_S} select concat('<knowledge_graph>', chr(10), string_agg({element(attrs(False, False, 'tier'))}, chr(10) order by case tier when 'scope_hot' then 0 when 'hot' then 1 else 2 end, type, name, id), chr(10), '</knowledge_graph>') as xml from t where tier is not null")
def _(fx):
    return R.stable_context(*sources(fx)).select("xml")


@query("f05_dynamic_context", f"with {_T.replace('from fx_nodes where', 'from fx_nodes where true and')}, u as (select * from t where not (list_contains({_FLAGS}, 'hot'))), {_EDGE.replace('join t a', 'join u a').replace('join t b', 'join u b')} select concat('<knowledge_graph>', chr(10), string_agg({element(attrs(True, True))}, chr(10) order by n, id), any_value({_INNER.format(o='name, from_id, to_id, id', w='')}), chr(10), '</knowledge_graph>') as xml from u where tier <> 'filtered'")
def _(fx):
    return R.dynamic_context(tiered(fx), fx.edges, A.hot(fx.nodes)).select("xml")


@query("f07_guidance", f"with {_S} select 'shown' as what, cast(length('{R.GUIDANCE}') + length('{R.SCOPE_GUIDANCE.replace(chr(39), chr(39) * 2)}') as bigint) as n union all select 'nothing', 0 union all select 'forced', length('{R.GUIDANCE}')")
def _(fx):
    s, h, a = sources(fx)
    some = R.merged_tiers(s, h, s.withColumn("tier", F.lit("L1")).limit(0), a)
    n = F.char_length("text").cast("long").alias("n")
    out = R.guidance(some).select(F.lit("shown").alias("what"), n)
    out = out.unionByName(R.guidance(some.limit(0)).select(F.lit("nothing").alias("what"), n))
    return out.unionByName(R.guidance(some.limit(0), True).select(F.lit("forced").alias("what"), n))


@query("f06_recall_index", f"with {_T} select concat('<knowledge_graph>', chr(10), string_agg(concat('  <', lower(type), ' name=\"', {e('name')}, '\"', case when tier = 'L1' then concat(' desc=\"', {e('description')}, '\"') else '' end, ' source=\"recalled\" tier=\"', lower(tier), '\"/>'), chr(10) order by n, id), chr(10), '</knowledge_graph>') as xml from t where tier in ('L1', 'L2') and not list_contains({_FLAGS}, 'hot')")
def _(fx):
    return R.recall_index(tiered(fx), A.hot(fx.nodes))


@query("x04_extraction_graph", f"""with {_T.replace('t as', 'r as', 1)}, t as (select * exclude (tier), case when tier = 'filtered' or tier = 'L3' and own then 'L2' else tier end as tier from (select *, list_contains(json_extract_string(source_sessions::json, '$[*]'), 's3') as own from r) where type not in ('TOPIC', 'SESSION') and (tier <> 'filtered' or own)),
  {_EDGE} select concat('<knowledge_graph>', chr(10), string_agg({element("concat(' tier=" + chr(34) + "', lower(tier), '" + chr(34) + "')")}, chr(10) order by id), any_value({_INNER.format(o='id', w="where ta in ('L1', 'L2') or tb in ('L1', 'L2')")}), chr(10), '</knowledge_graph>') as xml from t""")
def _(fx):
    rows = tiered(fx)
    return R.extraction_graph(rows.join(A.of_session(fx.nodes, "s3").select("id"), "id", "left_semi"), rows, fx.edges)


_EA = "replace({c}, '''', '&apos;')"


def ea(c: str) -> str:
    return _EA.format(c=e(c))


@query("x08_induction_input", f"""with tp as (select * from fx_nodes where type = 'TOPIC' and status = 'active'), sm as (select * from fx_nodes where type in ('TASK', 'SKILL') and status = 'active'), nm as (select id, name from tp union all select id, name from sm),
  l as (select 0 as k, id, concat('  <topic name="', name, '" desc="', {ea('substr(description, 1, 200)')}, '">', {ea('substr(content, 1, 300)')}, '</topic>') as s from tp union all select 1, id, concat('  <semantic type="', type, '" name="', name, '" desc="', {ea('substr(description, 1, 150)')}, '"/>') from sm
  union all select 2, d.id, concat('    <e name="', {ea('d.name')}, '" from="', a.name, '" to="', b.name, '"/>') from fx_edges d join nm a on a.id = d.from_id join nm b on b.id = d.to_id) select string_agg(s, chr(10) order by k, id) as text from l""")
def _(fx):
    n = A.active(fx.nodes)
    return R.induction_input(n.filter("type = 'TOPIC'"), n.filter("type in ('TASK', 'SKILL')"), fx.edges)


@query("f08_search_lines", f"""with {_T} select id, concat(case tier when 'L1' then '【L1-完整】' when 'L2' then '【L2-描述】' else '【L3-名称】' end, ' [', type, '] ', name, format(' (语义={{:.3f}}, PPR={{:.3f}}, PR={{:.3f}}, 综合={{:.3f}}, 置信度={{:.3f}})', pagerank, belief, belief, pagerank, belief),
  case tier when 'L1' then concat(chr(10), description, chr(10), substr(content, 1, 300)) when 'L2' then case when description <> '' then concat(chr(10), '描述: ', description) else '' end else '' end) as line from t where tier <> 'filtered'""")
def _(fx):
    rows = tiered(fx).withColumn("semantic", F.col("pagerank")).withColumn("combined", F.col("pagerank")).withColumn("display_ppr", F.col("belief")).withColumn("display_pagerank", F.col("belief"))
    return R.search_lines(rows).select("id", "line")


@query("f09_subgraph_edges", f"with {_T} select id from fx_edges where from_id in (select id from t where tier = 'L1') and to_id in (select id from t where tier = 'L1') union all select id from t where tier = 'L1'")
def _(fx):
    best = tiered(fx).filter("tier = 'L1'")
    return A.induced_edges(fx.edges, best).select("id").unionAll(best.select("id"))


@query("f10_subgraph_text", f"""with {_T}, s as (select * from t where n = 1), near as (select * from t where tier = 'L1' and n > 1), shown as (select id, name from near union all select id, name from s),
  l as (select 0 as k, id, concat('[seed] ', name, @ ) as line from s union all select 1, id, concat('[related] ', name, @ ) from near
  union all select 2, d.id, concat('  ', a.name, ' --[', d.name, ']--> ', b.name, ': ', d.description) from fx_edges d join shown a on a.id = d.from_id join shown b on b.id = d.to_id) select string_agg(line, chr(10) order by k, id) as text from l""".replace("@", "chr(10), '  type: ', type, format(' | confidence: {:.3f} | last used: ', belief), case when last_accessed_at > 0 then strftime(make_timestamp((last_accessed_at + 28800000) * 1000), '%Y/%-m/%-d %H:%M:%S') else 'never' end, chr(10), '  ', description, chr(10), '  ', content"))
def _(fx):
    rows = tiered(fx)
    return R.subgraph_text(rows.filter("place = 1"), rows.filter("place > 1"), fx.edges)


@query("e15_layer_changes", f"with {_T} select 'added' as change, id, tier, name from t where n in (11, 12) union all select 'removed', id, tier, name from t where n in (1, 2)")
def _(fx):
    rows = tiered(fx)
    return R.layer_changes(rows.filter("place <= 10"), rows.filter("place between 3 and 12")).select("change", "id", "tier", "name")


@query("e15_layer_digest", f"with {_T} select sha256(string_agg(concat_ws('|', id, tier, name), chr(10) order by id)) as digest from t where n <= 10")
def _(fx):
    return R.layer_digest(tiered(fx).filter("place <= 10"))
