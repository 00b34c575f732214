"""Text functions and full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search as S
from tessera.queries import query

NAMES = ["  Foo_Bar  baz ", "--A__b--", "知识 Graph!", "", "x-_-y", "Ünïcode"]
NOISE = [
    "I don't have any information", "im not sure about that", "I do not recall it", "I don't recall", "it looks like I don't", "no memories found", "我没有相关记忆", "我不确定", "我不记得了", "我无法访问", "do you remember me?", "Did I mention it", "what did I say", "你还记得吗",
    "我之前说过", "hello there", "HEARTBEAT ok", "fresh session start", "你好！", "早安", "新会话", "ok", "ok thanks", "ok, that is a long answer", "谢谢你的帮助", "谢谢分享，这个思路很好呢", "hm", "The cache is redis", "We use a good plan, hello", "行",
]
PROMPTS = ["/cmd do this", "[Mon 10:15] hello there", "plain", "Sender (untrusted metadata)\n```json\n{\"a\":1}\n```\nreal text", "Sender (untrusted metadata)\n{x}\nkeep me", "/a [x y] z"]
KEYS = [("agent:main:direct:U1", None), ("agent:x:group:G1:thread:9", None), ("a:channel:C", None), ("agent:b:explicit", None), ("plain", None), ("", "webchat"), (None, None), ("k:dm:Foo:Bar", "x")]


def _values(rows):
    return ", ".join("(" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


@query("s01_normalize_name", rf"""select t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[\s_]+', '-', 'g'), '[^a-z0-9一-鿿\-]', '', 'g'), '-{{2,}}', '-', 'g'), '^-|-$', '', 'g') as name from (values {_values(NAMES)}) v(t)""")
def _(fx):
    return fx.spark.createDataFrame([(n,) for n in NAMES], "t string").select("t", T.normalized_name(F.col("t")).alias("name"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_BREAKS = T.KEYWORD_BREAKS.replace("'", "''")


@query("s05_keywords", rf"select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '{_BREAKS}'), lambda w: length(w) > 1 and not list_contains({_STOP}, w) and not regexp_matches(w, '^[0-9]+$')))) as words from documents")
def _(fx):
    return fx.table("documents").select("doc_id", F.array_sort(T.keywords(F.col("text"))).alias("words"))


_Q = "the of onion and thing this re"
_KW = "['onion', 'thing', 're']"
_TEXT = "lower(concat_ws(' ', name, description, substr(content, 1, {n})))"


@query("s06_keyword_score", f"select id, case when list_bool_or(list_transform({_KW}, lambda w: contains({_TEXT.format(n=200)}, w))) then 1.0::double else 0.0::double end as score from fx_nodes")
def _(fx):
    return fx.nodes.select("id", T.keyword_hit(T.keywords(F.lit(_Q)), T.node_text(200)).alias("score"))


@query("s07_keyword_overlap", f"select id, round(len(list_filter({_KW}, lambda w: contains({_TEXT.format(n=500)}, w))) / 3.0::double, 6) as overlap from fx_nodes")
def _(fx):
    return fx.nodes.select("id", F.round(T.keyword_overlap(T.keywords(F.lit(_Q)), T.node_text(500)), 6).alias("overlap"))


def _noise_sql(c: str) -> str:
    tests = " or ".join(f"regexp_matches(trim({c}), '{p.replace(chr(39), chr(39) * 2)}')" for p in T.DENIALS + T.META_QUESTIONS + T.GREETINGS)
    short = " or ".join(f"regexp_matches(trim({c}), '{p}')" for p in T.SHORT_ACKS)
    return f"(length(trim({c})) < 3 or {tests} or (length(trim({c})) <= {T.SHORT_ACK_LENGTH} and ({short})))"


@query("s08_is_noise", f"select t, {_noise_sql('t')} as noise from (values {_values(NOISE)}) v(t)")
def _(fx):
    return fx.spark.createDataFrame([(n,) for n in NOISE], "t string").select("t", T.is_noise(F.col("t")).alias("noise"))


@query("s09_without_noise", f"select id from fx_messages where not {_noise_sql('content')}")
def _(fx):
    from tessera.operators.messages import without_noise

    return without_noise(fx.messages).select("id")


@query("s10_clean_prompt", f"""select t, case t when '/cmd do this' then 'do this' when '[Mon 10:15] hello there' then 'hello there' when '/a [x y] z' then 'z' when 'plain' then 'plain' else case when contains(t, 'json') then 'real text' else 'keep me' end end as cleaned from (values {_values(PROMPTS)}) v(t)""")
def _(fx):
    return fx.spark.createDataFrame([(n,) for n in PROMPTS], "t string").select("t", T.clean_prompt(F.col("t")).alias("cleaned"))


@query("s11_strip_memory", "select id, trim(content) as content from fx_messages")
def _(fx):
    marked = F.concat(F.lit(" <memory>\nold <b> text\n</memory>\n"), "content")
    return fx.messages.select("id", T.without_memory_block(marked).alias("content"))


@query("s12_prepended", "select id, case when turn_index % 2 = 0 then concat('note', chr(10), chr(10), content) else content end as content from fx_messages")
def _(fx):
    return fx.messages.select("id", T.prepended(F.col("content"), F.when(F.col("turn_index") % 2 == 0, "note").otherwise("  ")).alias("content"))


@query("s13_message_text", "select id, trim(concat(content, chr(10), role)) as text from fx_messages")
def _(fx):
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    blocks = F.array(block("text", F.col("content")), block("thinking", F.lit("hidden")), block("text", F.col("role")))
    return fx.messages.select("id", T.text_blocks(blocks).alias("text"))


def _rendered(most: int, head: str, tail: str, role: str = "") -> str:
    line = f"concat('[', upper(role), {head}']', chr(10), case when length(content) > {most} then concat(substr(content, 1, {most}), {tail}, length(content) - {most}, ' chars)') else content end)"
    return f"select session_id, string_agg({line}, concat(chr(10), chr(10), '---', chr(10), chr(10)) order by turn_index, id) as text from fx_messages {role} group by session_id"


@query("s14_render_messages", _rendered(800, "' t=', turn_index, ", "concat(chr(10), '...(truncated ')"))
def _(fx):
    from tessera.operators.messages import rendered

    return rendered(fx.messages)


@query("s15_render_session", _rendered(500, "", "'...(truncated '", "where role in ('user', 'assistant')"))
def _(fx):
    from tessera.operators.messages import rendered, talk

    return rendered(talk(fx.messages), 500, False, "...(truncated {} chars)")


@query("s16_escape_xml", "select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as a, replace(replace(replace(replace(replace(concat('it''s ', text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as b from documents")
def _(fx):
    return fx.table("documents").select("doc_id", T.escaped(F.col("text")).alias("a"), T.escaped(F.concat(F.lit("it's "), "text"), True).alias("b"))


@query("s17_tokens", "select doc_id, cast(ceil(length(text) / 3.0) as bigint) as tokens from documents")
def _(fx):
    return fx.table("documents").select("doc_id", T.tokens(F.char_length("text")).alias("tokens"))


ANSWERS = ['{"a":1}', '```json\n{"a":2}\n```', 'Sure: {"a":3} done', '<think>{x}</think>{"a":4}', "nothing here", '[1,2]', '<think>open {"a":5}']


@query("s18_json_part", f"select raw, case when contains(raw, '\"a\":1') then '{{\"a\":1}}' when contains(raw, '\"a\":2') then '{{\"a\":2}}' when contains(raw, '\"a\":3') then '{{\"a\":3}}' when contains(raw, '\"a\":4') then '{{\"a\":4}}' when contains(raw, 'open') then '' else raw end as part from (values {_values(ANSWERS)}) v(raw)")
def _(fx):
    return fx.spark.createDataFrame([(a,) for a in ANSWERS], "raw string").select("raw", T.json_part(F.col("raw")).alias("part"))


@query("s19_hashes", "select doc_id, md5(text) as m, substr(sha256(text), 1, 16) as p, sha1(text) as s from documents")
def _(fx):
    return fx.table("documents").select("doc_id", F.md5("text").alias("m"), T.prompt_hash(F.col("text")).alias("p"), F.sha1("text").alias("s"))


@query("s20_session_keys", f"""select k, p, case when contains(lower(k), ':group:') then 'group' when contains(lower(k), ':channel:') then 'channel' when contains(lower(k), ':direct:') or contains(lower(k), ':dm:') then 'direct'
    when split_part(lower(k), ':', 3) = 'explicit' and lower(k) like 'agent:%' then 'explicit' when p = 'webchat' then 'direct' when k <> '' then 'explicit' end as chat_type,
  case k when 'agent:main:direct:U1' then 'u1' when 'agent:x:group:G1:thread:9' then 'g1' when 'a:channel:C' then 'c' when 'k:dm:Foo:Bar' then 'foo:bar' when '' then null else lower(k) end as conversation_id,
  case when k like 'agent:%' then split_part(k, ':', 2) else 'main' end as agent_id from (values {_values(KEYS)}) v(k, p)""")
def _(fx):
    return fx.spark.createDataFrame(KEYS, "k string, p string").select("k", "p", T.chat_type(F.col("k"), F.col("p")).alias("chat_type"), T.conversation_id(F.col("k")).alias("conversation_id"), T.agent_id(F.col("k")).alias("agent_id"))


@query("g08_fingerprint", "select count(*) as n, count(distinct concat(role, '|', trim(content))) as n_distinct from fx_messages")
def _(fx):
    none = F.lit(None).cast("string")
    return fx.messages.select(T.fingerprint(F.col("role"), F.col("content"), none, none).alias("f")).agg(F.count("*").alias("n"), F.count_distinct("f").alias("n_distinct"))



@query("s02_full_text", rf"""with d as (select id, status, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, description, content)), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as w from fx_nodes),
  s as (select count(*)::double as n, avg(len(w)) as mean from d), tf as (select id, status, len(w) as len, t, len(list_filter(w, lambda x: x = t)) as tf from d, (values ('onion'), ('thing'), ('ereat'), ('than')) q(t)),
  df as (select t, count(*) as df from tf where tf > 0 group by t),
  sc as (select id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score from tf join df using (t), s where tf > 0 and status = 'active' group by id)
  select id, round(score, 6) as score from sc order by round(score, 6) desc, id limit 6""")
def _(fx):
    return S.matches(fx.nodes, "onion thing ereat than").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(6)


@query("s03_substring_search", "select id from fx_nodes where status = 'active' and (name ilike '%zzz%' or content ilike '%zzz%' or description ilike '%zzz%' or name ilike '%c-1%' or content ilike '%c-1%' or description ilike '%c-1%') order by pagerank desc, validated_count desc, updated_at desc, id limit 6")
def _(fx):
    return S.like_matches(fx.nodes, "zzz c-1").orderBy(*S.top_order()).limit(6).select("id")


@query("s04_empty_search", "select id from fx_nodes where status = 'active' order by pagerank desc, validated_count desc, updated_at desc, id limit 6")
def _(fx):
    return S.search(fx.nodes, "  ").select("id")


@query("z05_index_update", r"""with d as (select id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, description, case when id = 'n00000001' then 'new words here' else content end)), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as term from fx_nodes)
  select id, term, count(*) as tf from d group by id, term""")
def _(fx):
    changed = fx.nodes.filter("id = 'n00000001'").withColumn("content", F.lit("new words here"))
    return S.updated_index(S.index(fx.nodes), changed).select("id", "term", "tf")
