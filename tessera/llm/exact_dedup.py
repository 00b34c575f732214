"""Exact dedup: group by a 128-bit content hash, keep one row, compare bytes inside groups.

Hashes travel first: one narrow row a document is shuffled, with partial aggregation, so copies
are counted before the shuffle. Only texts whose hash occurs more than once are fetched again and
grouped by (hash, bytes), again with partial aggregation: equal bytes make a class, and texts that
merely collide part here. No group is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, materialize, sized, text_or_empty


def normalized(text: Column) -> Column:
    """The text without any white space of the contract."""
    return F.regexp_replace(text, SPACE, "")


def hash128(value: Column) -> Column:
    return F.unhex(F.md5(value))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = hash128, broadcast_bytes: int = BROADCAST_BYTES, with_key: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with most code points in its original text stays, then the smallest id. A null text
    counts as empty; all empty or blank texts are one group. A null id sorts after every other.
    Rows that repeat an id are members like others, and each row that equals the best in id and
    length is kept, since nothing tells them apart. An empty table gives no rows.
    Columns besides id and text are ignored, whatever their names. If asked, text_key (the whole
    text's 64-bit hash) tells rows of an id apart.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    norm = normalized(F.col("_text"))
    text_key = [F.xxhash64("_text").alias("text_key")] if with_key else []
    hashed = materialize(rows.select("_id", *text_key, F.char_length("_text").cast("long").alias("_n"), hash_fn(norm).alias("_h"), F.sha2(norm, 256).alias("_sha")), "hashes")
    repeated = materialize(hashed.groupBy("_h").count().filter("count > 1").select("_h"), "repeated")
    # Byte comparison: the text itself is a grouping key, behind the hash.
    classes = (
        rows.select("_id", F.char_length("_text").cast("long").alias("_n"), norm.alias("_norm"))
        .withColumn("_h", hash_fn(F.col("_norm")))
        .join(sized(repeated, 48, broadcast_bytes), "_h", "left_semi")
        .groupBy("_h", "_norm")
        .agg(F.count("*").alias("_size"), best.alias("_best"))
        .filter("_size > 1")
        .select("_h", F.sha2("_norm", 256).alias("_sha"), "_size", "_best")
    )
    found = hashed.join(sized(materialize(classes, "classes"), 192, broadcast_bytes), ["_h", "_sha"], "left")
    alone = F.col("_size").isNull()
    return found.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_id").eqNullSafe(F.col("_best.id")) & (F.col("_n") == -F.col("_best.n")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *(["text_key"] if with_key else []),
    )
