"""The engine's tables as deterministic views over the test tables, for queries and their SQL."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-02-01: the clock of all queries.
NOW_MS = 1_706_745_600_000

#: One definition for both engines; @MS(x) is epoch milliseconds, @COUNT the number of documents.
VIEWS = {
    "fx_nodes": """
        select concat('n', lpad(cast(d.doc_id as string), 8, '0')) as id,
          case d.doc_id % 7 when 0 then 'TASK' when 1 then 'SKILL' when 2 then 'EVENT' when 3 then 'KNOWLEDGE' when 4 then 'STATUS' when 5 then 'TOPIC' else 'SESSION' end as type,
          concat('doc-', cast(d.doc_id as string)) as name, substr(d.text, 1, 80) as description, d.text as content,
          case when l.quality = 0 then 'deprecated' else 'active' end as status, cast(1 + d.doc_id % 5 as bigint) as validated_count,
          concat('["s', cast(d.doc_id % 20 as string), '","s', cast(d.doc_id % 20 + 20 as string), '"]') as source_sessions,
          case d.doc_id % 50 when 0 then '["hot"]' when 1 then '["scope_hot:click"]' when 2 then '["hot-ish"]' when 3 then 'not json' when 4 then '{"hot":1}' when 5 then '["hot","scope_hot:view"]' else '[]' end as flags,
          cast(d.doc_id * 7919 % 1009 as double) / 1009 as pagerank,
          (1 + cast((d.doc_id % 4) * 0.5 as double)) / (2 + cast((d.doc_id % 4) * 0.5 as double) + cast((d.doc_id % 3) * 0.7 as double)) as belief,
          cast((d.doc_id % 4) * 0.5 as double) as success_count, cast((d.doc_id % 3) * 0.7 as double) as failure_count,
          cast(d.doc_id % 13 as bigint) as access_count,
          cast(case when d.doc_id % 13 = 0 then 0 else 1704067200000 + d.doc_id * 3600000 + (d.doc_id % 17) * 86400000 end as bigint) as last_accessed_at,
          cast(1704067200000 + d.doc_id * 3600000 as bigint) as created_at, cast(1704067200000 + d.doc_id * 3600000 + (d.doc_id % 11) * 86400000 as bigint) as updated_at
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "fx_edges": """
        select concat('e', kind, lpad(cast(i as string), 8, '0')) as id, concat('n', lpad(cast(i as string), 8, '0')) as from_id, concat('n', lpad(cast(j as string), 8, '0')) as to_id,
          name, concat(name, ' ', cast(i as string)) as description, concat('s', cast(i % 20 as string)) as session_id, cast(1704067200000 + i * 60000 as bigint) as created_at
        from (
          select 'a' as kind, d.doc_id as i, (d.doc_id * 7 + 1) % @COUNT as j, 'uses' as name from documents d where d.doc_id % 3 <> 2
          union all select 'b', doc_id, doc_id - doc_id % 10, 'depends' from documents where doc_id % 10 between 1 and 6
          union all select 'c', doc_id, doc_id - doc_id % 10, 'uses' from documents where doc_id % 10 = 4) t""",
    "fx_vectors": """
        select concat('n', lpad(cast(e.vec_id as string), 8, '0')) as node_id, e.embedding, e.label, md5(concat('doc-', cast(e.vec_id as string))) as content_hash,
          cast(1704067200000 + e.vec_id * 1000 as bigint) as updated_at, cast(case when e.vec_id % 3 = 0 then 0 else 1704067200000 + e.vec_id * 1000 end as bigint) as dedup_checked_at
        from embeddings e""",
    "fx_messages": """
        select concat('m', lpad(cast(conv_id as string), 6, '0'), '-', lpad(cast(turn as string), 4, '0')) as id, concat('s', cast(conv_id as string)) as session_id, cast(turn as int) as turn_index, role, text as content,
          turn < 3 as extracted, cast(1704067200000 + conv_id * 3600000 + turn * 60000 as bigint) as created_at
        from conversations""",
    "fx_recalled": """
        select concat('r', lpad(cast(e.event_id as string), 9, '0')) as id, concat('s', cast(e.user_id as string)) as session_id, cast(e.event_id % 8 as int) as turn_index,
          concat('n', lpad(cast(e.event_id * 31 % @COUNT as string), 8, '0')) as node_id,
          case when e.value >= 80 then 'L1' when e.value >= 40 then 'L2' when e.value >= 15 then 'L3' else 'filtered' end as tier,
          case when e.event_id % 6 = 0 then null else e.value / 500 end as semantic, @MS(e.ts) as created_at
        from events e where e.event_type in ('view', 'click')""",
    "fx_belief_signals": """
        select concat('b', lpad(cast(e.event_id as string), 9, '0')) as id, concat('n', lpad(cast(e.event_id * 17 % @COUNT as string), 8, '0')) as node_id,
          case when e.event_type = 'purchase' then 'supported' else 'contradicted' end as signal_type, greatest(cast(0.5 as double), least(cast(2.0 as double), e.value / 50)) as weight,
          concat('s', cast(e.user_id as string)) as session_id, @MS(e.ts) as created_at
        from events e where e.event_type in ('purchase', 'error')""",
    "fx_scopes": "select event_type as scope_name, concat('s', cast(user_id as string)) as session_id, min(@MS(ts)) as created_at from events where value > 150 group by event_type, user_id",
    "fx_graph_nodes": "select concat('p', cast(p_partkey as string)) as id from part union all select concat('s', cast(s_suppkey as string)) from supplier",
    "fx_graph_edges": "select concat('p', cast(l_partkey as string)) as from_id, concat('s', cast(l_suppkey as string)) as to_id from lineitem",
    "fx_neardup": """
        select concat('n', lpad(cast(vec_id as string), 8, '0')) as node_id, embedding, label from embeddings
        union all select concat('x', lpad(cast(vec_id as string), 8, '0')), @NUDGED, label from embeddings where vec_id % 10 = 0""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SPARK = {"@COUNT": "(select count(*) from documents)", "@NUDGED": "transform(embedding, x -> cast(x + 0.01D as float))"}
_DUCK = {"@COUNT": "(select count(*) from documents)", "@NUDGED": "list_transform(embedding, lambda x: (x::double + 0.01)::float)"}


def spark_sql(view: str) -> str:
    sql = re.sub(r"@MS\((\w+(?:\.\w+)?)\)", r"unix_millis(cast(\1 as timestamp))", VIEWS[view])
    for mark in ("@COUNT", "@NUDGED"):
        sql = sql.replace(mark, _SPARK[mark])
    return sql


def duck_sql(view: str) -> str:
    sql = re.sub(r"@MS\((\w+(?:\.\w+)?)\)", r"cast(epoch_us(\1) // 1000 as bigint)", VIEWS[view])
    for mark, value in _DUCK.items():
        sql = sql.replace(mark, value)
    return sql


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{v} as ({duck_sql(v)})" for v in used)
    head = sql.lstrip()
    if head[:5].lower() == "with ":
        recursive = head[5:15].lower() == "recursive "
        return f"with {'recursive ' if recursive else ''}{ctes}, {head[15 if recursive else 5:]}"
    return f"with {ctes} {sql}"


class Fixtures:
    """The views as DataFrames: nodes, edges and so on; table(name) for the test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.now = spark, sf_dir, NOW_MS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """Tables go in as arguments of spark.sql, so no names are registered for good."""
        sql = spark_sql(name)
        used = [t for t in TABLES if re.search(rf"\b(from|join)\s+{t}\b", sql)]
        for t in used:
            sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", sql)
        sql = re.sub(r"'\{\"hot\":1\}'", "'{{\"hot\":1}}'", sql)
        return self.spark.sql(sql, **{t: self.table(t) for t in used})

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return self.view("fx_nodes").withColumn("source_sessions", F.from_json("source_sessions", "array<string>"))

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.view(f"fx_{name}")
