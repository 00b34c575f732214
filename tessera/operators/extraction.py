"""What models answer, read by schema: extraction, finalization, induction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import json_part, normalized_name, strip
from tessera.sources.config import BELONGS, CONTAINS, PARENT, SEMANTIC_TYPES

ANSWER = """nodes array<struct<type:string,name:string,description:string,content:string>>,
  edges array<struct<`from`:string,`to`:string,name:string,description:string>>,
  beliefUpdates array<struct<nodeName:string,verdict:string,weight:double,reason:string>>,
  advisorySuggestions array<struct<nodeName:string,suggestion:string,reason:string,suggestedDocTitle:string>>"""
FINAL = """promotedSkills array<struct<type:string,name:string,description:string,content:string>>,
  newEdges array<struct<`from`:string,`to`:string,name:string,description:string>>, invalidations array<string>"""
INDUCED = """nodes array<struct<name:string,description:string,content:string>>, edges array<struct<`from`:string,`to`:string,name:string,description:string>>"""
SESSION = "description string, summary string"
#: Raw line breaks inside strings are let pass.
LENIENT = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}


def parsed(raw: Column, schema: str) -> Column:
    return F.from_json(json_part(raw), schema, LENIENT)


def _full(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & (F.coalesce(v, F.lit("")) != "")
    return out


def well_formed(raw: Column) -> Column:
    return F.from_json(json_part(raw), "map<string,string>", LENIENT).isNotNull() & F.coalesce(json_part(raw).startswith("{"), F.lit(False))


def extraction(answers: DataFrame, new_names: DataFrame | None = None) -> DataFrame:
    """answers: key columns and raw. Adds nodes, edges, beliefs, advice, and error (not JSON)."""
    j = answers.withColumn("_p", parsed(F.col("raw"), ANSWER))
    nodes = F.filter(F.col("_p.nodes"), lambda n: _full(n["name"], n["type"], n["content"]) & F.upper(n["type"]).isin(*SEMANTIC_TYPES))
    nodes = F.transform(nodes, lambda n: F.struct(F.upper(n["type"]).alias("type"), normalized_name(n["name"]).alias("name"), F.coalesce(n["description"], F.lit("")).alias("description"), n["content"].alias("content")))
    beliefs = F.filter(F.col("_p.beliefUpdates"), lambda u: _full(u["nodeName"], u["verdict"], u["reason"]) & (F.coalesce(u["weight"], F.lit(0.0)) != 0))
    beliefs = F.transform(beliefs, lambda u: F.struct(normalized_name(u["nodeName"]).alias("node_name"), u["verdict"].alias("verdict"), F.greatest(F.lit(0.5), F.least(F.lit(2.0), u["weight"])).alias("weight"), F.substring(u["reason"], 1, 200).alias("reason")))
    advice = F.filter(F.col("_p.advisorySuggestions"), lambda a: _full(a["nodeName"], a["suggestion"], a["reason"]))
    advice = F.transform(advice, lambda a: F.struct(normalized_name(a["nodeName"]).alias("node_name"), F.substring(a["suggestion"], 1, 200).alias("suggestion"), F.substring(a["reason"], 1, 300).alias("reason"), F.substring(a["suggestedDocTitle"], 1, 100).alias("title")))
    edges = _edges(F.col("_p.edges"))
    return j.select(*answers.columns, *[F.coalesce(c, F.array()).alias(n) for c, n in ((nodes, "nodes"), (edges, "edges"), (beliefs, "beliefs"), (advice, "advice"))], (~well_formed(F.col("raw"))).alias("error"))


def _edges(c: Column) -> Column:
    good = F.filter(c, lambda e: _full(e["from"], e["to"], e["name"], e["description"]))
    return F.transform(good, lambda e: F.struct(normalized_name(e["from"]).alias("from"), normalized_name(e["to"]).alias("to"), e["name"].alias("name"), e["description"].alias("description")))


def advice_for(new_names: DataFrame, advice: DataFrame) -> DataFrame:
    """Advice (node_name, suggestion, reason, ...) on nodes that are new, with a key against repeats."""
    kept = advice.join(new_names.select(F.col("name").alias("node_name")).distinct(), "node_name", "left_semi")
    return kept.withColumn("key", F.sha2(F.concat_ws("\x1f", "node_name", "suggestion"), 256)).dropDuplicates(["key"])


def finalization(answers: DataFrame) -> DataFrame:
    """Adds skills, edges, invalid; all empty for what isn't JSON."""
    p = parsed(F.col("raw"), FINAL)
    j = answers.withColumn("_p", p)
    skills = F.filter(F.col("_p.promotedSkills"), lambda n: _full(n["name"], n["content"]))
    return j.select(*answers.columns, F.coalesce(skills, F.array()).alias("skills"), F.coalesce(_edges(F.col("_p.newEdges")), F.array()).alias("edges"), F.coalesce(F.col("_p.invalidations"), F.array()).alias("invalid"))


def _first_of(array: Column, key) -> Column:
    """The array without elements whose key an earlier one has."""
    seen = F.transform(array, key)
    return F.filter(array, lambda x, i: F.array_position(seen, key(x)) == i + 1)


def induction(answers: DataFrame) -> DataFrame:
    """Adds nodes (distinct names; cut at 200 and 300) and edges (distinct keys; cut at 200)."""
    j = answers.withColumn("_p", parsed(F.col("raw"), INDUCED))
    nodes = F.filter(F.col("_p.nodes"), lambda n: _full(n["name"]) & (_full(n["description"]) | _full(n["content"])))
    some = lambda a, b: F.when(_full(a), a).otherwise(b)
    nodes = F.transform(nodes, lambda n: F.struct(normalized_name(n["name"]).alias("name"), F.substring(strip(F.coalesce(n["description"], F.lit(""))), 1, 200).alias("description"), F.substring(strip(F.coalesce(some(n["content"], n["description"]), F.lit(""))), 1, 300).alias("content")))
    edges = F.transform(_edges(F.col("_p.edges")), lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), strip(e["name"]).alias("name"), F.substring(strip(e["description"]), 1, 200).alias("description")))
    j = j.withColumn("_n", F.coalesce(nodes, F.array())).withColumn("_e", F.coalesce(edges, F.array()))
    nodes = _first_of(F.col("_n"), lambda n: n["name"])
    edges = _first_of(F.col("_e"), lambda e: F.concat_ws("|", e["from"], e["to"], e["name"]))
    return j.select(*answers.columns, nodes.alias("nodes"), edges.alias("edges"))


def session_summary(answers: DataFrame) -> DataFrame:
    p = parsed(F.col("raw"), SESSION)
    return answers.withColumn("_p", p).select(*answers.columns, F.substring(strip(F.coalesce("_p.description", F.lit(""))), 1, 200).alias("description"), F.substring(strip(F.coalesce("_p.summary", F.lit(""))), 1, 500).alias("summary"))


def allowed_edges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """edges: from_name, to_name, name, description; types: name, type. Those that topics may have."""
    j = edges.join(types.select(F.col("name").alias("from_name"), F.col("type").alias("_ft")), "from_name").join(types.select(F.col("name").alias("to_name"), F.col("type").alias("_tt")), "to_name")
    belongs = (F.col("name") == BELONGS) & F.col("_ft").isin(*SEMANTIC_TYPES) & (F.col("_tt") == "TOPIC")
    between = F.col("name").isin(CONTAINS, PARENT) & (F.col("_ft") == "TOPIC") & (F.col("_tt") == "TOPIC")
    return j.filter(belongs | between).select(*edges.columns)


def repaired(transcript: DataFrame) -> DataFrame:
    """transcript: session, pos, role, call_ids (of an assistant's message), result_id, stopped.

    Each call is followed by its first result of the turn, or by a made-up one; other results go.
    Returns session, ord, role, result_id, made, pos, as columns of one repaired transcript.
    """
    import pandas as pd

    def fix(t: pd.DataFrame) -> pd.DataFrame:
        rows = list(t.sort_values("pos").itertuples(index=False))
        out, used = [], set()
        turn = [k for k, r in enumerate(rows) if r.role == "assistant"] + [len(rows)]
        for r in rows[: turn[0]]:
            if r.role != "toolResult":
                out.append((r.role, r.result_id, False, r.pos))
        for a, b in zip(turn, turn[1:], strict=False):
            head, rest = rows[a], rows[a + 1 : b]
            calls = [] if head.stopped or head.call_ids is None else list(head.call_ids)
            out.append((head.role, None, False, head.pos))
            first = {}
            for r in rest:
                if r.role == "toolResult" and r.result_id in calls and r.result_id not in used:
                    first.setdefault(r.result_id, r)
            for c in calls:
                if c not in used:
                    used.add(c)
                    out.append(("toolResult", c, c not in first, first[c].pos if c in first else None))
            out += [(r.role, r.result_id, False, r.pos) for r in rest if r.role != "toolResult"]
        done = pd.DataFrame(out, columns=["role", "result_id", "made", "pos"])
        done["pos"] = done["pos"].astype("Int32")
        return done.assign(session=t["session"].iloc[0], ord=range(len(done)))[["session", "ord", "role", "result_id", "made", "pos"]]

    return transcript.groupBy("session").applyInPandas(fix, "session string, ord int, role string, result_id string, made boolean, pos int")
