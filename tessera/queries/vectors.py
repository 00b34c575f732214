"""Vectors and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scores import cosine
from tessera.operators import neardup as D
from tessera.operators import vectors as V
from tessera.queries import query
from tessera.sources.fixtures import NOW_MS
from tessera.sources.snapshots import materialized

_Q = "(select embedding from embeddings where vec_id = 0)"
_COS = "list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])) + 1e-9)"


def query_vector(fx) -> list[float]:
    return fx.table("embeddings").filter("vec_id = 0").first()["embedding"]


@query("v01_cosine", f"select e.vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) as score from embeddings e, {_Q} q")
def _(fx):
    q = V.vector(query_vector(fx))
    return fx.table("embeddings").select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("score"))


@query("v02_top_k", f"select node_id, round({_COS.format(a='v.embedding', b='q.embedding')}, 6) as score from fx_vectors v, {_Q} q where {_COS.format(a='v.embedding', b='q.embedding')} > 0.1 and node_id in (select id from fx_nodes where status = 'active') order by 2 desc, node_id limit 15")
def _(fx):
    return V.top_k(fx.nodes, fx.vectors, query_vector(fx), 15, 0.1).withColumn("score", F.round("score", 6))


@query("v04_norms", "select node_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from fx_vectors")
def _(fx):
    return V.with_norms(fx.vectors).select("node_id", F.round("norm", 6).alias("norm"))


@query("v05_save_vectors", f"select node_id, case when label = 1 then 'new-hash' else content_hash end as content_hash, case when label = 1 then {NOW_MS} else updated_at end as updated_at, case when label = 1 then 0 else dedup_checked_at end as dedup_checked_at from fx_vectors union all select 'fresh', 'h', {NOW_MS}, 0")
def _(fx):
    v = fx.vectors
    changed = v.filter("label = 1").select("node_id", "embedding", F.lit("new-hash").alias("content_hash"))
    same = v.filter("label = 2").select("node_id", "embedding", "content_hash")
    fresh = v.limit(1).select(F.lit("fresh").alias("node_id"), "embedding", F.lit("h").alias("content_hash"))
    return V.save(v, changed.unionByName(same).unionByName(fresh), fx.now).select("node_id", "content_hash", "updated_at", "dedup_checked_at")


@query("v06_typed_vectors", "select node_id, type from fx_vectors v join fx_nodes n on n.id = v.node_id where n.status = 'active'")
def _(fx):
    return V.typed(fx.vectors, fx.nodes).select("node_id", "type")


@query("v07_embed_text", "select id, concat(name, ': ', description, chr(10), substr(content, 1, 500)) as text from fx_nodes")
def _(fx):
    return fx.nodes.select("id", V.embed_text().alias("text"))


@query("v08_embed_changed", "select node_id, len(embedding) as dims from (select id as node_id, [0.0, 0.0, 0.0] as embedding from fx_nodes where status = 'active')")
def _(fx):
    def provider(texts):
        return [[float(len(t)), 1.0, 0.5] for t in texts]

    return V.embedded(fx.nodes, fx.vectors, provider).select("node_id", F.size("embedding").cast("long").alias("dims"))


@query("v09_embedding_state", """select state, count(*) as n from (select case when v.node_id is null then 'missing' when v.content_hash = md5(concat(name, ': ', description, chr(10), substr(content, 1, 500))) then 'unchanged' else 'changed' end as state
  from fx_nodes n left join (select node_id, case when label < 5 then md5(t) else content_hash end as content_hash from fx_vectors left join (select id, concat(name, ': ', description, chr(10), substr(content, 1, 500)) as t from fx_nodes) x on x.id = node_id) v on v.node_id = n.id where n.status = 'active') group by state""")
def _(fx):
    texts = fx.nodes.select(F.col("id").alias("node_id"), F.md5(V.embed_text()).alias("h"))
    v = fx.vectors.join(texts, "node_id", "left").withColumn("content_hash", F.when(F.col("label") < 5, F.col("h")).otherwise(F.col("content_hash")))
    return V.embedding_state(fx.nodes, v).groupBy("state").agg(F.count("*").alias("n"))


@query("v11_pending", "select node_id from fx_vectors v join fx_nodes n on n.id = v.node_id where n.status = 'active' and dedup_checked_at < v.updated_at order by dedup_checked_at, v.updated_at, node_id limit 40")
def _(fx):
    return V.pending(fx.vectors, fx.nodes, 40).select("node_id")


@query("v12_checked_candidates", "select node_id from fx_vectors v join fx_nodes n on n.id = v.node_id where n.status = 'active' and dedup_checked_at >= v.updated_at and type in ('TASK', 'TOPIC')")
def _(fx):
    return V.checked_candidates(fx.vectors, fx.nodes, ["TASK", "TOPIC"]).select("node_id")


@query("v13_mark_checked", f"select node_id, case when label = 3 then greatest({NOW_MS}, updated_at) else dedup_checked_at end as dedup_checked_at from fx_vectors")
def _(fx):
    return V.mark_checked(fx.vectors, fx.vectors.filter("label = 3"), fx.now).select("node_id", "dedup_checked_at")


def _typed(fx):
    return fx.neardup.select("node_id", "embedding", F.col("label").cast("string").alias("type"))


_PAIRS = f"select a.node_id as a, b.node_id as b, a.label, {_COS.format(a='a.embedding', b='b.embedding')} as s from fx_neardup a join fx_neardup b on a.label = b.label and a.node_id < b.node_id"


@query("d02_all_pairs", f"select a, b, round(s, 6) as similarity from ({_PAIRS}) where s >= 0.9")
def _(fx):
    return D.all_pairs(_typed(fx), limit=None).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("d02_pairs_capped", f"select a, b from ({_PAIRS}) where s >= 0.9 order by label::varchar, a, b limit 20")
def _(fx):
    return D.all_pairs(_typed(fx), 0.9, 20).select("a", "b")


@query("d03_incremental_pairs", f"select a, b, round(s, 6) as similarity from ({_PAIRS}) where s >= 0.9 and (a like 'x%' or b like 'x%' )")
def _(fx):
    t = _typed(fx)
    pairs = D.incremental_pairs(t.filter("node_id like 'x%'"), t.filter("node_id like 'n%'"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("similarity", 6).alias("similarity"))


@query("d04_comparisons", "with p as (select label::varchar as type, count(*) filter (node_id like 'x%') as p, count(*) filter (node_id like 'n%') as c from fx_neardup group by label) select type, p * (p - 1) // 2 + p * c as n from p where p > 0")
def _(fx):
    t = _typed(fx)
    return D.comparisons(t.filter("node_id like 'x%'"), t.filter("node_id like 'n%'"))


@query("d05_greedy_merges", f"select case when a_is_older then a else b end as merge_id, case when a_is_older then b else a end as keep_id from (select a, b, true as a_is_older from ({_PAIRS}) where s >= 0.9)")
def _(fx):
    nodes = fx.neardup.select(F.col("node_id").alias("id"), F.lit(1).cast("long").alias("validated_count"), F.when(F.col("node_id").startswith("x"), 2).otherwise(1).cast("long").alias("updated_at"))
    return D.greedy_merges(materialized(D.all_pairs(_typed(fx), limit=None), "pairs"), nodes, None).select("merge_id", "keep_id")


@query("d06_dedup_report", "with p as (select count(*) as n from fx_neardup where node_id like 'x%') select n as pending_before, 0::bigint as pending_after, n as checked, n as pairs, n as merged from p")
def _(fx):
    from tessera.plans.maintenance import Tables, dedup

    v = fx.neardup.select("node_id", "embedding", F.lit("").alias("content_hash"), F.lit(10).cast("long").alias("updated_at"), F.when(F.col("node_id").startswith("x"), 0).otherwise(10).cast("long").alias("dedup_checked_at"))
    base = fx.nodes.limit(1)
    named = fx.neardup.select(F.col("node_id").alias("id"), F.col("label").cast("string").alias("type"))
    fill = {c: F.lit(None) for c in base.columns} | {"status": F.lit("active"), "name": F.col("id"), "validated_count": F.lit(1).cast("long"), "content": F.lit("c"), "description": F.lit("d"), "flags": F.lit("[]"), "updated_at": F.lit(1).cast("long"), "success_count": F.lit(0.0), "failure_count": F.lit(0.0), "belief": F.lit(0.5), "source_sessions": F.array(F.lit("s"))}
    nodes = named.select(*[F.col(c) if c in ("id", "type") else fill[c].cast(base.schema[c].dataType).alias(c) for c in base.columns])
    _, report = dedup(Tables(nodes, fx.edges.limit(0), v, fx.messages, fx.recalled), fx.now, budgets=False)
    return report
