"""Context as XML and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CHARS_PER_TOKEN, escaped
from tessera.operators.ranking import priority

GUIDANCE = (
    "The entries below were recorded in earlier sessions. They are hints, not facts: check them before relying on them. "
    "Fields of an entry: name, desc, source, tier, confidence (0 to 1), updated."
)
SCOPE_GUIDANCE = " Entries of tier scope_hot belong to this session's scope and are always shown."


def joined(df: DataFrame, line: str, order: list[str], separator: str = "\n") -> DataFrame:
    """One row, text: the lines in order. For rendered contexts, which are short."""
    sort = F.struct(*[F.col(c) for c in order], F.col(line).alias("_line"))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(sort)), lambda x: x["_line"]), separator).alias("text"))


def merged_tiers(scope_hot: DataFrame, hot: DataFrame, recalled: DataFrame, active: DataFrame) -> DataFrame:
    """Nodes of all sources once, each with its best tier; recalled brings its own tier column."""
    columns = [c for c in recalled.columns if c != "tier"]
    parts = [scope_hot.select(*columns, F.lit("scope_hot").alias("tier")), hot.select(*columns, F.lit("hot").alias("tier")), recalled.select(*columns, "tier"), active.select(*columns, F.lit("active").alias("tier"))]
    both = parts[0].withColumn("_src", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("_src", F.lit(k)))
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(priority(F.col("tier"))), "_src"))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_src")


def merged_edges(active: DataFrame, recalled: DataFrame) -> DataFrame:
    both = active.withColumn("_src", F.lit(0)).unionByName(recalled.withColumn("_src", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("id").orderBy("_src"))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_src")


def attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value, F.lit('"'))


def node_elements(nodes: DataFrame, confidence: bool = True, updated: bool = True) -> DataFrame:
    """Adds element: L3 a name, L2 a description too, better tiers the content as well."""
    tag = F.lower("type")
    recalled = F.col("tier").isin("L1", "L2", "L3")
    head = F.concat(F.lit("  <"), tag, attribute("name", escaped(F.col("name"))))
    desc = attribute("desc", escaped(F.coalesce("description", F.lit(""))))
    tail = F.concat(attribute("source", F.when(recalled, "recalled").otherwise(F.col("tier"))), attribute("tier", F.lower("tier")))
    if confidence:
        tail = F.concat(tail, F.when(F.col("belief").isNotNull(), attribute("confidence", F.format_string("%.2f", "belief"))).otherwise(F.lit("")))
    if updated:
        tail = F.concat(tail, attribute("updated", F.date_format(F.timestamp_millis("updated_at"), "yyyy-MM-dd")))
    full = F.concat(head, desc, tail, F.when(F.col("tier") == "scope_hot", F.lit(' scope_hot="true"')).otherwise(F.lit("")), F.lit(">\n"), escaped(F.regexp_replace("content", r"^\s+|\s+$", "")), F.lit("\n  </"), tag, F.lit(">"))
    shape = F.when(F.col("tier") == "L3", F.concat(head, tail, F.lit("/>"))).when(F.col("tier") == "L2", F.concat(head, desc, tail, F.lit("/>"))).otherwise(full)
    return nodes.filter("tier <> 'filtered'").withColumn("element", shape)


def edge_elements(edges: DataFrame, nodes: DataFrame, described: tuple[str, ...] = ("hot", "active", "L1")) -> DataFrame:
    """Edges with both ends shown; the description where an end's tier is among described."""
    shown = nodes.filter("tier <> 'filtered'").select("id", F.col("name").alias("_n"), F.col("tier").alias("_t"))
    j = edges.join(shown.toDF("from_id", "from_name", "from_tier"), "from_id").join(shown.toDF("to_id", "to_name", "to_tier"), "to_id")
    head = F.concat(F.lit("    <e"), attribute("name", escaped(F.col("name"))), attribute("from", escaped(F.col("from_name"))), attribute("to", escaped(F.col("to_name"))))
    full = F.concat(head, F.lit(">"), escaped(F.coalesce("description", F.lit(""))), F.lit("</e>"))
    rich = F.col("from_tier").isin(*described) | F.col("to_tier").isin(*described)
    return j.dropDuplicates(["id"]).withColumn("element", F.when(rich, full).otherwise(F.concat(head, F.lit("/>"))))


def knowledge_graph(nodes: DataFrame, edges: DataFrame | None, confidence: bool = True, updated: bool = True, order: list[str] | None = None) -> DataFrame:
    """One row: xml (null without nodes) and tokens. Nodes in order of (tier, type, name, id), or as
    given; edges by (name, from, to, id)."""
    items = node_elements(nodes, confidence, updated).withColumn("_tier", -priority(F.col("tier")))
    body = joined(items, "element", order or ["_tier", "type", "name", "id"])
    if edges is not None:
        lines = joined(edge_elements(edges, nodes), "element", ["name", "from_id", "to_id", "id"])
        body = body.withColumn("_", F.lit(1)).join(lines.select(F.col("text").alias("e"), F.lit(1).alias("_")), "_")
        inner = F.when(F.col("e") != "", F.concat(F.lit("\n  <edges>\n"), F.col("e"), F.lit("\n  </edges>"))).otherwise(F.lit(""))
    else:
        inner = F.lit("")
    xml = F.when(F.col("text") != "", F.concat(F.lit("<knowledge_graph>\n"), F.col("text"), inner, F.lit("\n</knowledge_graph>")))
    return body.select(xml.alias("xml")).withColumn("tokens", F.coalesce(F.ceil(F.char_length("xml") / CHARS_PER_TOKEN), F.lit(0)).cast("long"))


def guidance(nodes: DataFrame, force: bool = False) -> DataFrame:
    """One row, text: how to read the shown nodes (tier); empty without any, unless forced."""
    shown = F.count_if(F.col("tier") != "filtered")
    scoped = F.when(F.count_if(F.col("tier") == "scope_hot") > 0, SCOPE_GUIDANCE).otherwise("")
    return nodes.agg(F.when((shown > 0) | F.lit(force), F.concat(F.lit(GUIDANCE), scoped)).otherwise("").alias("text"))


def stable_context(scope_hot: DataFrame, hot: DataFrame, active: DataFrame) -> DataFrame:
    """Sorted, without edges and volatile fields, so that a prompt's beginning stays the same."""
    none = scope_hot.withColumn("tier", F.lit("filtered")).limit(0)
    return knowledge_graph(merged_tiers(scope_hot, hot, none, active), None, confidence=False, updated=False)


def dynamic_context(recalled: DataFrame, edges: DataFrame, stable_ids: DataFrame) -> DataFrame:
    """Recalled nodes (with place) that aren't in the stable part, in order of rank, and edges."""
    rest = recalled.join(stable_ids.select("id"), "id", "left_anti")
    return knowledge_graph(rest, edges, order=["place", "id"])


def recall_index(recalled: DataFrame, stable_ids: DataFrame) -> DataFrame:
    """Names and descriptions of L1, names of L2."""
    rest = recalled.join(stable_ids.select("id"), "id", "left_anti").filter(F.col("tier").isin("L1", "L2"))
    desc = F.when(F.col("tier") == "L1", attribute("desc", escaped(F.coalesce("description", F.lit(""))))).otherwise(F.lit(""))
    line = F.concat(F.lit("  <"), F.lower("type"), attribute("name", escaped(F.col("name"))), desc, F.lit(' source="recalled"'), attribute("tier", F.lower("tier")), F.lit("/>"))
    body = joined(rest.withColumn("element", line), "element", ["place", "id"])
    return body.select(F.when(F.col("text") != "", F.concat(F.lit("<knowledge_graph>\n"), F.col("text"), F.lit("\n</knowledge_graph>"))).alias("xml"))


def extraction_graph(session: DataFrame, recalled: DataFrame, edges: DataFrame) -> DataFrame:
    """What an extractor sees: recalled tiers and the session's nodes as L2, without topics and
    sessions; edges with an end in L1 or L2."""
    columns = [c for c in recalled.columns if c not in ("tier", "place")]
    kept = ~F.col("type").isin("TOPIC", "SESSION")
    both = recalled.filter(kept & (F.col("tier") != "filtered")).select(*columns, "tier").unionByName(session.filter(kept).select(*columns, F.lit("L2").alias("tier")))
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(priority(F.col("tier")))))
    nodes = both.withColumn("_n", n).filter("_n = 1").drop("_n")
    tag, head = F.lower("type"), F.concat(F.lit("  <"), F.lower("type"), attribute("name", escaped(F.col("name"))))
    tier, desc = attribute("tier", F.lower("tier")), attribute("desc", escaped(F.coalesce("description", F.lit(""))))
    full = F.concat(head, desc, tier, F.lit(">\n"), escaped(F.regexp_replace("content", r"^\s+|\s+$", "")), F.lit("\n  </"), tag, F.lit(">"))
    shape = F.when(F.col("tier") == "L3", F.concat(head, tier, F.lit("/>"))).when(F.col("tier") == "L2", F.concat(head, desc, tier, F.lit("/>"))).otherwise(full)
    body = joined(nodes.withColumn("element", shape), "element", ["id"])
    near = edge_elements(edges, nodes, described=("L1",)).filter("from_tier in ('L1', 'L2') or to_tier in ('L1', 'L2')")
    lines = joined(near, "element", ["id"])
    j = body.withColumn("_", F.lit(1)).join(lines.select(F.col("text").alias("e"), F.lit(1).alias("_")), "_")
    inner = F.when(F.col("e") != "", F.concat(F.lit("\n  <edges>\n"), F.col("e"), F.lit("\n  </edges>"))).otherwise(F.lit(""))
    return j.select(F.when(F.col("text") != "", F.concat(F.lit("<knowledge_graph>\n"), F.col("text"), inner, F.lit("\n</knowledge_graph>"))).otherwise(F.lit("")).alias("xml"))


def induction_input(topics: DataFrame, semantic: DataFrame, edges: DataFrame) -> DataFrame:
    """Topics with content, other nodes with descriptions, and the edges among them."""
    t = topics.select("id", F.lit(0).alias("k"), F.concat(F.lit('  <topic name="'), F.col("name"), F.lit('" desc="'), escaped(F.substring("description", 1, 200), True), F.lit('">'), escaped(F.substring("content", 1, 300), True), F.lit("</topic>")).alias("element"))
    s = semantic.select("id", F.lit(1).alias("k"), F.concat(F.lit('  <semantic type="'), F.col("type"), F.lit('" name="'), F.col("name"), F.lit('" desc="'), escaped(F.substring("description", 1, 150), True), F.lit('"/>')).alias("element"))
    names = topics.select("id", "name").unionByName(semantic.select("id", "name"))
    e = edges.join(names.toDF("from_id", "_f"), "from_id").join(names.toDF("to_id", "_t"), "to_id")
    e = e.select("id", F.lit(2).alias("k"), F.concat(F.lit('    <e name="'), escaped(F.col("name"), True), F.lit('" from="'), F.col("_f"), F.lit('" to="'), F.col("_t"), F.lit('"/>')).alias("element"))
    return joined(t.unionByName(s).unionByName(e), "element", ["k", "id"])


# Labels of the search result.
TIER_LABELS = {"hot": "【🔥HOT】", "L1": "【L1-完整】", "L2": "【L2-描述】"}
OTHER_LABEL = "【L3-名称】"


def search_lines(rows: DataFrame) -> DataFrame:
    """Adds line to shown rows (with semantic, display_ppr, display_pagerank, combined, belief)."""
    label = F.lit(OTHER_LABEL)
    for tier, text in TIER_LABELS.items():
        label = F.when(F.col("tier") == tier, text).otherwise(label)
    named = (("语义", "semantic"), ("PPR", "display_ppr"), ("PR", "display_pagerank"), ("综合", "combined"), ("置信度", "belief"))
    scores = F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.format_string(f"{n}=%.3f", c)) for n, c in named])
    extra = F.when(F.col("tier") == "L1", F.concat(F.lit("\n"), F.coalesce("description", F.lit("")), F.lit("\n"), F.substring("content", 1, 300))).when((F.col("tier") == "L2") & (F.col("description") != ""), F.concat(F.lit("\n描述: "), F.col("description"))).otherwise(F.lit(""))
    line = F.concat(label, F.lit(" ["), F.col("type"), F.lit("] "), F.col("name"), F.when(scores != "", F.concat(F.lit(" ("), scores, F.lit(")"))).otherwise(F.lit("")), extra)
    return rows.filter("tier <> 'filtered'").withColumn("line", line)


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select("id", "name")
    j = edges.join(names.toDF("from_id", "_f"), "from_id").join(names.toDF("to_id", "_t"), "to_id")
    return j.withColumn("line", F.concat(F.lit("  "), F.col("_f"), F.lit(" --["), F.col("name"), F.lit("]--> "), F.col("_t"), F.lit(": "), F.col("description")))


def subgraph_text(seed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The seed, the L1 nodes around it, and the edges among them, as text."""
    last = F.when(F.col("last_accessed_at") > 0, F.date_format(F.from_utc_timestamp(F.timestamp_millis("last_accessed_at"), "Asia/Shanghai"), "yyyy/M/d HH:mm:ss")).otherwise("never")

    def block(df: DataFrame, k: int, title: str) -> DataFrame:
        text = F.concat(F.lit(f"[{title}] "), F.col("name"), F.lit("\n  type: "), F.col("type"), F.lit(" | confidence: "), F.format_string("%.3f", F.coalesce("belief", F.lit(0.5))), F.lit(" | last used: "), last, F.lit("\n  "), F.coalesce("description", F.lit("")), F.lit("\n  "), F.coalesce("content", F.lit("")))
        return df.select(F.lit(k).alias("k"), "id", text.alias("line"))

    near = nodes.filter("tier = 'L1'").join(seed.select("id"), "id", "left_anti")
    shown = near.select("id", "name").unionByName(seed.select("id", "name"))
    lines = edge_lines(edges, shown).select(F.lit(2).alias("k"), "id", "line")
    return joined(block(seed, 0, "seed").unionByName(block(near, 1, "related")).unionByName(lines), "line", ["k", "id"])


def layer_digest(items: DataFrame) -> DataFrame:
    """One row: digest of the sorted items (id, tier, name)."""
    line = F.concat_ws("|", "id", "tier", "name")
    return joined(items.withColumn("line", line), "line", ["id"]).select(F.sha2("text", 256).alias("digest"))


def layer_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """change, id, tier, name: what the stable layer gained and lost."""
    c = ["id", "tier", "name"]
    return after.select(*c).exceptAll(before.select(*c)).withColumn("change", F.lit("added")).unionByName(before.select(*c).exceptAll(after.select(*c)).withColumn("change", F.lit("removed")))
