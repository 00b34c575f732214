"""Graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import access as A
from tessera.operators import graph as G
from tessera.queries import query

_LIVE = "live as materialized (select id from fx_nodes where status = 'active')"
_ADJ = """adj as materialized (select src, dst, count(*) as w from (select from_id as src, to_id as dst from {e} union all select to_id, from_id from {e}) where src in (select id from live) and dst in (select id from live) group by src, dst),
  deg as materialized (select src, sum(w) as d from adj group by src), p as materialized (select src, dst, w / d as p from adj join deg using (src))"""


def pagerank_sql(live: str, edges: str, seeds: str | None, rounds: int = 20) -> str:
    """CTEs ending in pr(id, score)."""
    start = f"select id, case when id in ({seeds}) then 1.0::double else 0.0::double end as t from live" if seeds else "select id, 1.0::double as t from live"
    parts = [live, _ADJ.format(e=edges), f"tel as materialized (select id, t / sum(t) over () as t from ({start}))", "r0 as materialized (select id, t as score from tel)"]
    for k in range(rounds):
        parts.append(f"""r{k + 1} as materialized (select tel.id, 0.15 * tel.t + 0.85 * (coalesce(g, 0) + (select coalesce(sum(score), 0) from r{k} where id not in (select src from deg)) * tel.t) as score
          from tel left join (select dst, sum(score * p) as g from p join r{k} on r{k}.id = p.src group by dst) x on x.dst = tel.id)""")
    parts.append(f"pr as (select id, score from r{rounds})")
    return ", ".join(parts)


_SEEDS = "select unnest(['n00000000', 'n00000014'])"


def seeds(fx, *ids):
    return fx.spark.createDataFrame([(i,) for i in ids], "id string")


@query("h01_adjacency", "with " + _LIVE + ", " + _ADJ.format(e="fx_edges") + " select src, dst, w from adj")
def _(fx):
    return G.adjacency(A.active(fx.nodes), fx.edges)


_WALK = f"""s0 as materialized (select id, 0 as depth, '' as via from fx_nodes where id in ({_SEEDS})),
  s1 as materialized (select id, 1 as depth, min(via) as via from (select to_id as id, e.id as via from fx_edges e join s0 on s0.id = from_id union all select from_id, e.id from fx_edges e join s0 on s0.id = to_id) where id not in (select id from s0) and id in (select id from fx_nodes) group by id),
  s2 as materialized (select id, 2 as depth, min(via) as via from (select to_id as id, e.id as via from fx_edges e join s1 on s1.id = from_id union all select from_id, e.id from fx_edges e join s1 on s1.id = to_id) where id not in (select id from s0 union all select id from s1) and id in (select id from fx_nodes) group by id),
  reached as materialized (select * from (select * from s0 union all select * from s1 union all select * from s2) order by depth, via, id limit {{most}})"""


@query("h02_walk", "with " + _WALK.format(most=1500) + " select n.id, r.depth from fx_nodes n join reached r on r.id = n.id where n.status = 'active'")
def _(fx):
    return G.walk(fx.nodes, fx.edges, seeds(fx, "n00000000", "n00000014"))[0].select("id", "depth")


@query("h02_walk_capped_edges", "with " + _WALK.format(most=12) + " select id from fx_edges where from_id in (select id from reached) and to_id in (select id from reached)")
def _(fx):
    return G.walk(fx.nodes, fx.edges, seeds(fx, "n00000000", "n00000014"), 2, 12)[1].select("id")


@query("h03_personalized_pagerank", "with " + pagerank_sql(_LIVE, "fx_edges", _SEEDS) + " select id, round(score, 9) as score from pr")
def _(fx):
    live = A.active(fx.nodes)
    return G.pagerank(live, G.adjacency(live, fx.edges), seeds(fx, "n00000000", "n00000014")).withColumn("score", F.round("score", 9))


@query("h04_global_pagerank", "with " + pagerank_sql(_LIVE, "fx_edges", None) + " select id, round(score, 9) as score from pr")
def _(fx):
    live = A.active(fx.nodes)
    return G.pagerank(live, G.adjacency(live, fx.edges)).withColumn("score", F.round("score", 9))


@query("h04_pagerank_joined", "with " + pagerank_sql(_LIVE, "fx_edges", None, 4) + " select id, round(score, 9) as score from pr")
def _(fx):
    """The way of large graphs, on a small one."""
    live = A.active(fx.nodes)
    return G.pagerank(live, G.adjacency(live, fx.edges), iterations=4, kernel_rows=0).withColumn("score", F.round("score", 9))


@query("h03_pagerank_large", "with " + pagerank_sql("live as materialized (select id from fx_graph_nodes)", "fx_graph_edges", "select unnest(['p1', 's1'])") + " select id, round(score, 9) as score from pr")
def _(fx):
    nodes = fx.graph_nodes
    return G.pagerank(nodes, G.adjacency(nodes, fx.graph_edges), seeds(fx, "p1", "s1")).withColumn("score", F.round("score", 9))
