"""Benchmark decontamination by a prefix-filtered join of shingles.

A window is ``width`` consecutive words of an item, or the whole item if it is shorter. A document
contains a window only if it contains each of the window's shingles (up to SHINGLE words) at the
right distance; so the window's rarest shingle is the whole necessary prefix. The steps:

1. Rarity: one pass counts the words of all documents into BUCKETS hash buckets, by partial
   aggregation; a shingle is at most as frequent as its rarest word's bucket. Each window keeps its
   rarest shingle. Windows with a word whose bucket is empty go.
2. Hits: the places of prefix shingles, and of no others. The prefix is broadcast if its counted
   size fits, so documents aren't shuffled.
3. Candidates: the windows that a hit implies, if they lie inside the document (position and length
   bound).
4. Exact check in the document's own row, CHUNK words at a time: the words at a candidate's place
   must be the window's, first by hash, then by the words themselves.

All steps are DataFrame operations; hot shingles and passages spread over documents, and nothing
is gathered by shingle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fold_split, materialize, sized, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
SHINGLE = 3
#: Hash buckets of the word counts.
BUCKETS = 1 << 16
#: Words of a row in the exact check.
CHUNK = 4096
#: Bytes that a broadcast row of a few words, and one of a few numbers takes, generously.
ROW_BYTES, KEY_BYTES = 256, 64


def words(text: Column) -> Column:
    return fold_split(text, SEPARATORS)


def shingles(array: str, k: int) -> Column:
    """Structs (a, b and so on) of each k consecutive words of the named array column; the last
    k - 1 hold nulls."""
    column = F.col(array)
    return F.arrays_zip(*(F.slice(column, F.lit(i + 1), F.greatest(F.size(column), F.lit(0))).alias("abc"[i]) for i in range(k)))


def token(row: str, k: int) -> Column:
    """A shingle's hash; null for one with nulls."""
    parts = [F.col(f"{row}.{c}") for c in "abc"[:k]]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def windows_of(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """item, win (its words joined by spaces), len, w (its words): one row per window."""
    split = items.select(F.col(item_col).alias("item"), words(text_or_empty(text_col)).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    each = split.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(width)).alias("w"))
    return each.select("item", F.array_join("w", " ").alias("win"), F.size("w").alias("len"), "w")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES, with_key: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside occurrences of windows), item_ids
    (the items with occurring windows, as sorted strings).

    Null texts and items have no words and match nothing; an item with a null id counts for hits,
    but is named in no list. Rows are told apart by id and text, so null and repeated ids are
    served; equal rows get equal results. Extra columns are ignored, whatever their names; empty
    tables give no rows, or rows without hits. If asked, text_key (the text's 64-bit hash) tells
    rows of an id apart.
    """
    windows = materialize(windows_of(items, item_col, item_text_col, width), "windows")
    unique = materialize(windows.select("win", "len", "w", F.xxhash64("w").alias("hash")).distinct(), "unique")
    k = F.least(F.lit(SHINGLE), F.col("len"))
    sizes = sorted(r["k"] for r in unique.select(k.alias("k")).distinct().collect()) or [SHINGLE]

    def sent(df: DataFrame, row_bytes: int = KEY_BYTES) -> DataFrame:
        return sized(df, row_bytes, broadcast_bytes)

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), words(text_or_empty(text_col)).alias("words"))
    counts = materialize(texts.select(F.explode("words").alias("word")).groupBy(bucket(F.col("word")).alias("bucket")).count(), "counts")
    rows = [unique.filter(k == n).select("win", "len", "hash", F.posexplode(shingles("w", n)).alias("off", "s")).select("win", "len", "hash", "off", token("s", n).alias("tok"), F.array(*(F.col(f"s.{c}") for c in "abc"[:n])).alias("own")) for n in sizes]
    tokens = reduce(DataFrame.unionByName, rows).filter("tok is not null")
    seen = tokens.select("win", "len", "hash", "off", "tok", F.explode("own").alias("word")).withColumn("bucket", bucket(F.col("word"))).join(F.broadcast(counts), "bucket", "left")
    seen = seen.groupBy("win", "len", "hash", "off", "tok").agg(F.min(F.coalesce("count", F.lit(0))).alias("n"))
    prefix = seen.groupBy("win", "len", "hash").agg(F.min(F.struct("n", "off", "tok")).alias("r")).filter("r.n > 0").select("len", "hash", F.col("r.tok").alias("tok"), F.col("r.off").alias("off")).distinct()
    prefix = materialize(prefix, "prefix")

    placed = texts.select("id", "key", F.size("words").alias("n"), F.posexplode(shingles("words", max(sizes))).alias("pos", "s"))
    if len(sizes) == 1:
        placed = placed.select("id", "key", "n", "pos", token("s", sizes[0]).alias("tok"))
    else:
        placed = placed.select("id", "key", "n", "pos", F.explode(F.array(*(token("s", n) for n in sizes))).alias("tok"))
    hits = materialize(placed.filter("tok is not null").join(sent(prefix.select("tok").distinct()), "tok"), "hits")
    start = F.col("pos") - F.col("off")
    candidates = hits.join(sent(prefix), "tok").withColumn("start", start).filter("start >= 0 and start + len <= n")
    candidates = candidates.select("id", "key", F.floor(F.col("start") / CHUNK).cast("int").alias("chunk"), F.struct("start", "len", "hash").alias("c")).groupBy("id", "key", "chunk").agg(F.collect_set("c").alias("cs"), F.count("*").alias("size"))
    candidates = materialize(candidates, "candidates")

    some = materialize(candidates.select("id", "key").distinct(), "some")
    own = texts["id"].eqNullSafe(some["id"]) & (texts["key"] == some["key"])
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / CHUNK).cast("int")), lambda i: F.struct(i.alias("piece"), F.slice("words", i * CHUNK + 1, F.lit(CHUNK + width)).alias("part")))
    parts = texts.join(sent(some), own, "left_semi").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.inline(pieces))
    few = F.broadcast(candidates) if (candidates.agg(F.sum("size")).first()[0] or 0) * KEY_BYTES <= broadcast_bytes else candidates
    there = parts.join(few, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")) & (F.col("piece") == F.col("chunk")))

    def at(c: Column) -> Column:
        return F.slice("part", (c["start"] - F.col("chunk") * CHUNK + 1).cast("int"), c["len"])

    same = F.transform(F.filter("cs", lambda c: F.xxhash64(at(c)) == c["hash"]), lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), F.array_join(at(c), " ").alias("win")))
    found = there.select("id", "key", F.inline(same)).join(sent(unique.select("win", "len"), ROW_BYTES), ["win", "len"], "left_semi")
    found = materialize(found.select("id", "key", "start", "len", "win").distinct(), "found")

    spans = found.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    begin = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def cover_more(state: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(state["to"], end).alias("to"), (state["n"] + F.greatest(end - F.greatest(s["start"], state["to"]), F.lit(0))).alias("n"))

    covered = spans.select("id", "key", F.aggregate("spans", begin, cover_more, lambda s: s["n"]).alias("n_hit"))
    named = found.select("id", "key", "win").distinct().join(sent(materialize(windows.select("win", "item").distinct(), "named"), ROW_BYTES), "win")
    named = named.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    both = covered.alias("a").join(named.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key"))).select("a.id", "a.key", "n_hit", "item_ids")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.size(words(text_or_empty(text_col))).cast("long").alias("n_words"))
    joined = rows.alias("r").join(both.alias("f"), F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.key") == F.col("f.key")), "left")
    text_key = [F.col("r.key").alias("text_key")] if with_key else []
    return joined.select(F.col("r.id").alias(id_col), *text_key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
