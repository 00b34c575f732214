"""The queries opN_<name> of this subpackage, by the contracts, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, licenses, packing, pii, secret_scan, toxicity
from .common import UPPER, read
from .decontaminate import overlaps
from .exact_dedup import exact_dedup
from .near_dedup import near_duplicates


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two deliveries: one half of the documents, then all, of which only unseen blobs are scanned."""
    docs = read(spark, sf_dir, "documents")
    ledger, _ = secret_scan.extend_ledger(docs.filter(_remainder(2) == 0))
    ledger, _ = secret_scan.extend_ledger(docs, ledger)
    rows = secret_scan.findings_by_path(docs, ledger)
    base = F.filter("findings", lambda f: f["ord"] < len(secret_scan.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("path").alias("doc_id"), *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("findings")).alias("spans"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def tokenizer_files() -> tuple[str, str]:
    """The rank file and the splitting pattern of the public byte-level BPE with 50k tokens. Its
    ids equal those of byte_bpe_50k.json, which holds the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), *tokenizer_files())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(_remainder(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: <source>/<thousands of doc_id>/<doc_id>.txt, or LICENSE-<doc_id> for every
    50th, so that folders have license files wherever those hold a notice."""
    i = F.col("doc_id")
    name = F.when(i % 50 == 0, F.concat(F.lit("LICENSE-"), i)).otherwise(F.concat(i, F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000).cast("string"), name)
    return licenses.scan(read(spark, sf_dir, "documents").withColumn("path", path), keep=("doc_id",))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_remainder(4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pii": op2_pii,
    "op3_html_text": op3_html_text,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: (kind, pattern, group, least), written out here, so that SQL doesn't repeat a slip of the rules.
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
)


def _duck_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
      select doc_id, {order} as ord, '{kind}' as kind, list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) as s, m[i] as len, {order} < 3 as base
      from (select doc_id, unnest(range(1, len(p) + 1)) as i, p, m, g from (
        select doc_id, list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) as p, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) as m,
          list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) as g from docs)) where p[i] >= {least}"""


ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": f"""
      with n as (select doc_id, length(coalesce(text, '')) as len, {_NORM} as norm from documents),
      g as (select norm, count(*) as group_size, max(len) as most from n group by norm),
      b as (select n.norm, min(doc_id) as keep_id from n join g on n.norm = g.norm and n.len = g.most group by n.norm)
      select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.norm) as text_sha256
      from n join g on n.norm = g.norm join b on n.norm = b.norm""",
    "op8_decontaminate": rf"""
      with dw as (select doc_id, {_WORDS} as w from documents), bw as (select item_id, {_WORDS} as w from benchmark),
      wins as (select item_id, unnest(case when len(w) < 10 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) end) as win, least(len(w), 10) as n from bw where len(w) > 0),
      grams as (select doc_id, l.n, unnest(range(1, len(w) - l.n + 2)) as i, w from dw, (select distinct n from wins) l where len(w) >= l.n),
      occ as (select g.doc_id, g.i, g.n, x.item_id from grams g join wins x on x.n = g.n and x.win = array_to_string(g.w[g.i:g.i + g.n - 1], ' ')),
      hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
      named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from occ) group by doc_id)
      select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
      from dw d left join hit h on d.doc_id = h.doc_id left join named m on d.doc_id = m.doc_id""",
    "op10_secret_scan": "with docs as (select doc_id, coalesce(text, '') as t from documents), spans as ("
    + " union all ".join(_duck_spans(kind, k, *rest) for k, (kind, *rest) in enumerate(_SECRETS))
    + """), j as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h,
      string_agg(concat(kind, ':', s::bigint, ':', (s + len)::bigint), ',' order by s, ord) filter (base) as b, string_agg(concat(kind, ':', s::bigint, ':', (s + len)::bigint), ',' order by s, ord) as x from spans group by doc_id)
    select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(x, '') as spans
    from docs d left join j on d.doc_id = j.doc_id""",
}
