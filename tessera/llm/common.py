"""What the operators of this subpackage share: sized joins, text columns, Arrow batches; and
materialize(), which writes a table into the shared folder and reads it back: lineage ends there, and
a lost executor costs no recomputation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.snapshots import materialized as materialize

__all__ = ["append_columns", "ascii_lower", "bound_batches", "encoded", "fold_split", "materialize", "read", "sized", "text_or_empty"]

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys of at most so many bytes are broadcast; larger key sets are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch that goes to Python.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sized(keys: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """keys with a broadcast hint if, as counted, they fit the limit; else as they are, and the
    join shuffles. keys should be materialized: they are counted here."""
    return F.broadcast(keys) if keys.count() * row_bytes <= limit else keys


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else. In pure ASCII text lower() does just that, much faster."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))


def fold_split(column: Column, separators: str) -> Column:
    """The non-empty parts of the ASCII-lower-cased text between runs of separators."""
    return F.filter(F.split(ascii_lower(column), separators), lambda w: w != "")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, not only in rows, for texts may be long. A bound that the
    session has already stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def append_columns(df: DataFrame, text_col: str, keep: list[str], fields: str, fn: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """The columns keep, untouched, and those of fields, which fn makes from the texts of a batch.
    Kept columns stay in Arrow, so nulls and large integers are safe."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=names)

    schema = df.select(*keep).schema
    for f in StructType.fromDDL(fields):
        schema = schema.add(f.name, f.dataType)
    names = schema.names
    return df.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(run, schema)


def encoded(texts: list[str | None]) -> list[bytes]:
    """UTF-8; null counts as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
