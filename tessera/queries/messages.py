"""Messages, signals, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import messages as M
from tessera.operators import mutate
from tessera.queries import query
from tessera.sources.fixtures import NOW_MS


@query("g01_save_message", "select id from fx_messages union select 'm-new'")
def _(fx):
    m = fx.messages
    new = m.limit(1).withColumn("id", F.lit("m-new"))
    return mutate.appended(m, new.unionByName(new).unionByName(m.filter("turn_index = 0"))).select("id")


@query("g02_ingest", """with n as (select session_id, max(turn_index) as t from fx_messages group by session_id)
  select c.session_id, cast(coalesce(t, -1) + row_number() over (partition by c.session_id order by seq) as int) as turn_index, c.content
  from (select session_id, turn_index as seq, content from fx_messages where turn_index < 3 union all select 'brand-new', 1, 'hi') c left join n on c.session_id = n.session_id""")
def _(fx):
    m = fx.messages
    batch = m.filter("turn_index < 3").select("session_id", "role", "content", F.col("turn_index").alias("seq")).unionByName(fx.spark.createDataFrame([("brand-new", "user", "hi", 1)], "session_id string, role string, content string, seq int"))
    return M.ingested(m, batch, fx.now).select("session_id", "turn_index", "content")


@query("g03_session_messages", "select * from (select id, turn_index from fx_messages where session_id = 's4' order by turn_index desc, id limit 3)")
def _(fx):
    return M.of_session(fx.messages, "s4", 3).select("id", "turn_index")


@query("g04_unextracted", "select id from fx_messages where session_id = 's6' and not extracted order by turn_index, id limit 50")
def _(fx):
    return M.unextracted(fx.messages, "s6").select("id")


_TURNS = """with r as (select *, row_number() over (partition by session_id order by turn_index desc, id) as back from fx_messages where extracted),
  t as (select *, coalesce(sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by back desc rows between unbounded preceding and 1 preceding), 0) as turn from r where back <= 20 * {n})"""


@query("g05_context_reference", _TURNS.format(n=1) + " select id, row_number() over (partition by session_id order by turn, back) as ord from t where turn < 1")
def _(fx):
    return M.recent_extracted(fx.messages, 1).select("id", F.col("ord").cast("long").alias("ord"))


@query("g05_context_latest", _TURNS.format(n=1) + ", m as (select *, max(turn) over (partition by session_id) as last from t) select id, row_number() over (partition by session_id order by back desc) as ord from m where turn > last - 1")
def _(fx):
    return M.recent_extracted(fx.messages, 1, "latest").select("id", F.col("ord").cast("long").alias("ord"))


@query("g06_mark_extracted", "select id, extracted or (session_id in ('s1', 's2') and turn_index <= 4) as extracted from fx_messages")
def _(fx):
    upto = fx.spark.createDataFrame([("s1", 4), ("s2", 4)], "session_id string, upto int")
    return M.mark_extracted(fx.messages, upto).select("id", "extracted")


@query("g07_new_messages", """with b as (select session_id, turn_index as seq, md5(content) as fingerprint, count(*) over (partition by session_id) as n from fx_messages),
  c as (select session_id, case when session_id = 's1' then 2 end as explicit, case when session_id = 's2' then 1 when session_id = 's3' then 99 end as remembered from (select distinct session_id from fx_messages))
  select b.session_id, b.seq from b join c using (session_id) where seq >= coalesce(case when explicit is not null then least(explicit, n) end, case when remembered <= n then remembered end, greatest(n - 8, 0))
  and not exists (select 1 from fx_messages m where m.turn_index = 3 and m.session_id = b.session_id and md5(m.content) = b.fingerprint)""")
def _(fx):
    m = fx.messages
    batch = m.select("session_id", F.col("turn_index").alias("seq"), F.md5("content").alias("fingerprint"))
    counts = m.select("session_id").distinct().withColumn("explicit", F.when(F.col("session_id") == "s1", 2)).withColumn("remembered", F.when(F.col("session_id") == "s2", 1).when(F.col("session_id") == "s3", 99))
    return M.new_messages(batch, m.filter("turn_index = 3").select("session_id", F.md5("content").alias("fingerprint")), counts).select("session_id", "seq")


@query("g09_signals", "select id, turn_index from fx_messages where session_id = 's6' and turn_index % 2 = 1 order by turn_index")
def _(fx):
    signals = fx.messages.select("id", "session_id", "turn_index", F.lit(False).alias("processed"))
    done = M.mark_done(signals, signals.filter("turn_index % 2 = 0"))
    return M.pending(done, "s6").select("id", "turn_index")


_OLD = f"created_at < {NOW_MS} - 86400000 and session_id not in ('s0', 's1', 's2', 's3', 's4', 's5', 's6', 's7', 's8', 's9')"


@query("g10_retention", f"""select kind, id from (select 'message' as kind, 0 as k, id, created_at from fx_messages where {_OLD} union all select 'recall', 1, id, created_at from fx_recalled where {_OLD}) order by k, created_at, id limit 50""")
def _(fx):
    protected = fx.spark.createDataFrame([(f"s{k}",) for k in range(10)], "session_id string")
    return M.retention(fx.messages, fx.recalled, protected, fx.now, 1, 50)


@query("g10_retention_unprotected", "select 'message' as kind, id from fx_messages where false")
def _(fx):
    return M.retention(fx.messages, fx.recalled, fx.spark.createDataFrame([], "session_id string"), fx.now, 1, 50)


@query("g11_protected_sessions", f"select distinct session_id from fx_scopes where scope_name = 'error' or created_at >= {NOW_MS} - 10 * 86400000")
def _(fx):
    sessions = fx.scopes.select("session_id", (F.col("scope_name") == "error").alias("running"), F.col("created_at").alias("updated_at"))
    return M.protected_sessions(sessions, fx.now - 10 * 86_400_000)


@query("g12_recall_rows", "select node_id, tier from fx_recalled where session_id = 's5' and turn_index = 3 and tier <> 'filtered'")
def _(fx):
    rows = fx.recalled.filter("session_id = 's5' and turn_index = 3").select(F.col("node_id").alias("id"), "tier", "semantic", F.lit(0.0).alias("ppr"), F.lit(0.0).alias("pagerank"))
    return M.recall_rows(rows, "s5", 3, fx.now).select("node_id", "tier")


@query("g13_talk", "select id, content from fx_messages where role in ('user', 'assistant')")
def _(fx):
    wrapped = fx.messages.withColumn("content", F.when(F.col("turn_index") % 2 == 0, F.to_json(F.struct("role", "content"))).otherwise(F.col("content")))
    return M.talk(wrapped).select("id", "content")


@query("g14_last_turns", """with o as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by turn_index, id) as opened, sum(case when role = 'user' then 1 else 0 end) over (partition by session_id) as users from fx_messages)
  select id, cast(ceil(length(content) / 3.0) as bigint) as tokens from o where opened > 0 and users - opened < 2 and (role in ('user', 'assistant') and content <> '' or users = opened)""")
def _(fx):
    return M.last_turns(fx.messages, 2).select("id", "tokens")


@query("g15_compact_active", """with r as (select id, type, updated_at, row_number() over (partition by type order by updated_at desc, id desc) as r, count(*) over () as n from fx_nodes where status = 'active'),
  loose as (select id, row_number() over (order by updated_at, id) as k, n from r where type <> 'SKILL' and r > case type when 'TASK' then 5 when 'EVENT' then 10 when 'KNOWLEDGE' then 10 else 0 end)
  select id from r where id not in (select id from loose where k <= n - 60)""")
def _(fx):
    return M.compacted(fx.nodes.filter("status = 'active'"), 60).select("id")
