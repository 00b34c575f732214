"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet into the
shared folder and read again as the next stage's docs. All but the last return the columns of docs.

Rows are told apart by doc_id (null-safe) and a hash of their text, so null and repeated ids are
served: only rows whose own text is decided against go. A null text is empty: the first stage drops
it. An empty table gives no rows; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read, sized
from tessera.llm.decontaminate import overlaps
from tessera.llm.exact_dedup import exact_dedup, normalized
from tessera.llm.language_id import UNDETERMINED, identify, train
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.queries import tokenizer_files


def without(docs: DataFrame, dropped: DataFrame, key: Column, bytes_per_row: int = 64) -> DataFrame:
    """docs without the rows whose doc_id (null-safe) and key, an expression over docs, occur
    together in dropped (doc_id, key)."""
    dropped = materialize(dropped.distinct(), "dropped").toDF("_id", "_key")
    return docs.join(sized(dropped, bytes_per_row), docs["doc_id"].eqNullSafe(dropped["_id"]) & (key == dropped["_key"]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: those without a letter, and those that no
    learned language explains. Nothing to learn from: all go."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = identify(rows, train(docs), keep=["doc_id", "text_key"], reject=True)
    return without(docs, found.filter(F.col("lang_pred") == UNDETERMINED).select("doc_id", "text_key"), F.xxhash64(docs["text"]))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays; of rows that also share the id, one."""
    decided = materialize(exact_dedup(docs, with_key=True), "decided")
    text = F.coalesce(docs["text"], F.lit(""))
    again = materialize(decided.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").drop("count"), "again").toDF("_id", "_sha")
    rest = without(docs, decided.filter("not kept").select("doc_id", "text_key"), F.xxhash64(text))
    if again.isEmpty():
        return rest
    repeated = docs["doc_id"].eqNullSafe(again["_id"]) & (F.sha2(normalized(text), 256) == again["_sha"])
    once = rest.join(sized(again, 160), repeated, "left_semi")
    norm = _free(docs, "norm")
    once = once.withColumn(norm, normalized(text)).dropDuplicates(["doc_id", norm]).drop(norm)
    return rest.join(sized(again, 160), repeated, "left_anti").unionByName(once)


def _free(docs: DataFrame, name: str) -> str:
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. Shingles are of five words (op1's are of
    four, by its contract), similarity is 0.8 or more."""
    copies = near_duplicates(docs, size=5, percent=80, with_key=True).filter("not kept").select("doc_id", "text_key")
    return without(docs, copies, F.xxhash64(docs["text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    found = overlaps(docs, read(spark, sf_dir, "benchmark"), with_key=True).filter("n_hit > 0").select("doc_id", "text_key")
    return without(docs, found, F.xxhash64(docs["text"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token sequences."""
    return pack(docs, *tokenizer_files())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", dedup_exact),
    ("near-dedup", dedup_near),
    ("decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: Language ID, near-dedup and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
