"""Best-fit packing of documents into token sequences, by a linear grouping scheme.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the plan is made
on the driver from their counts, whatever the number of documents, and is itself a short table:

1. Lengths above a part of the capacity are large. Sorted, they are cut into GROUPS groups of equal
   cardinality, and each is rounded up to the largest of its group: few sizes remain.
2. Configurations of these few sizes are chosen one after another: the largest size left plus the
   combination that fills the rest best (a knapsack over the sizes left), as often as the demand
   allows.
3. Actual lengths take the places of rounded ones, so the gaps are what they really leave.
4. Small lengths, longest first, go where they fit best; new sequences are opened at the end.

The plan maps (length, rank among the pieces of that length) to a sequence and an offset. Ranks
are distributed: pieces of a length are dealt into buckets of about BUCKET rows, ranked inside them,
and shifted by the counts of earlier buckets, which are summed in two levels; no length is ranked
or summed in one task.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, materialize

CAPACITY = 2048
#: Boundaries between small and large that are planned; the plan with fewest sequences is used.
SMALL_PARTS, GROUPS = (2, 3, 4, 8), 64
BUCKET = 200
#: Ends each document.
END_ID = 0
#: The added tokens of byte_bpe_50k.json, found in texts before any splitting.
ADDED = {"<|endoftext|>": 50256}


@functools.cache
def encoder(ranks_path: str, pattern: str):
    """The byte-level BPE of a rank file, with the added tokens."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones behind a first one
    that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (of unsigned little-endian 32-bit ids), and if asked ids."""

    kind = f"piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}"
    schema = StructType().add("id", "long")
    for f in StructType.fromDDL(kind):
        schema = schema.add(f.name, f.dataType)
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = functools.partial(encoder(ranks_path, pattern).encode, allowed_special=set(ADDED))
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text), END_ID], "<u4")
                for p, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    rows.append(k)
                    out.append((p, start, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            made = [pa.array([r[c] for r in out], t) for c, t in enumerate(types[: len(schema) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *made], names=schema.names)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


class Plan:
    """Rows (length, first rank, count, first sequence, pieces of this row per sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, small_part: int = SMALL_PARTS[0], groups: int = GROUPS):
        self.capacity, self.sequences, self.rows = capacity, 0, []
        self.rank = dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[list[int]]] = {}  # gap: [first sequence, count]
        large = [(n, counts[n]) for n in sorted(counts, reverse=True) if n > capacity // small_part]
        self._pack_large(self._grouped(large, groups))
        for n in sorted((n for n in counts if n <= capacity // small_part), reverse=True):
            self._best_fit(n, counts[n])

    @staticmethod
    def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
        """Runs [length, count] of each group, longest first; the first length is the rounded one."""
        total = sum(c for _, c in large)
        each, out, room = -(-total // groups) if total else 1, [], 0
        for n, c in large:
            while c:
                if not room:
                    out.append([])
                    room = each
                take = min(c, room)
                out[-1].append([n, take])
                c, room = c - take, room - take
        return out

    def _configuration(self, sizes: list[int], left: list[int]) -> list[int]:
        """How many of each size: the largest one left, and the fullest rest."""
        first = next(k for k, n in enumerate(left) if n)
        use, rest = [0] * len(sizes), self.capacity - sizes[first]
        use[first] = 1
        reach = np.zeros(rest + 1, bool)
        reach[0] = True
        by, times = np.full(rest + 1, -1), np.zeros(rest + 1, int)
        for k in range(first, len(sizes)):  # larger sizes first: fewer pieces
            s, most = sizes[k], left[k] - use[k]
            if not most or s > rest:
                continue
            old = reach.copy()
            for m in range(1, min(most, rest // s) + 1):
                new = np.zeros(rest + 1, bool)
                new[m * s :] = old[: rest + 1 - m * s]
                new &= ~reach
                by[new], times[new] = k, m
                reach |= new
            if reach[rest]:
                break
        at = int(np.flatnonzero(reach)[-1])
        while at:
            k, m = int(by[at]), int(times[at])
            use[k] += m
            at -= m * sizes[k]
        return use

    def _pack_large(self, groups: list[list[list[int]]]) -> None:
        sizes, left = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
        while any(left):
            use = self._configuration(sizes, left)
            times = min(n // u for n, u in zip(left, use, strict=True) if u)
            slots = []
            for k, u in enumerate(use):
                left[k] -= u * times
                slots += [self._taken(groups[k], times) for _ in range(u)]
            self._substitute(slots, times)

    @staticmethod
    def _taken(runs: list[list[int]], n: int) -> list[list[int]]:
        out = []
        while n:
            take = min(n, runs[0][1])
            out.append([runs[0][0], take])
            runs[0][1] -= take
            n -= take
            if not runs[0][1]:
                runs.pop(0)
        return out

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """Sequences of one configuration, cut wherever an actual length changes."""
        while times:
            n = min(s[0][1] for s in slots)
            offset = 0
            for s in slots:
                length = s[0][0]
                self._add(length, n, self.sequences, 1, offset)
                offset += length
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            self._leave(self.capacity - offset, self.sequences, n)
            self.sequences += n
            times -= n

    def _add(self, length: int, count: int, sequence: int, per: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], count, sequence, per, offset))
        self.rank[length] += count

    def _leave(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            self.gaps.setdefault(gap, []).append([sequence, count])

    def _best_fit(self, length: int, count: int) -> None:
        for gap in sorted(g for g in self.gaps if g >= length):
            runs, per = self.gaps[gap], gap // length
            while count and runs:
                sequence, there = runs.pop()
                full = min(there, count // per)
                if full:
                    self._add(length, full * per, sequence, per, self.capacity - gap)
                    self._leave(gap - per * length, sequence, full)
                    count -= full * per
                if full < there:
                    if count:  # fewer than would fill one more
                        self._add(length, count, sequence + full, per, self.capacity - gap)
                        self._leave(gap - count * length, sequence + full, 1)
                        full, count = full + 1, 0
                    self._leave(gap, sequence + full, there - full)
            if not runs:
                del self.gaps[gap]
            if not count:
                return
        per = self.capacity // length
        full, rest = divmod(count, per)
        if full:
            self._add(length, full * per, self.sequences, per, 0)
            self._leave(self.capacity - per * length, self.sequences, full)
        if rest:
            self._add(length, rest, self.sequences + full, per, 0)
            self._leave(self.capacity - rest * length, self.sequences + full, 1)
        self.sequences += full + bool(rest)

    def table(self) -> np.ndarray:
        """The rows by length and first rank."""
        rows = np.array(self.rows, np.int64).reshape(-1, 6)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return min((Plan(counts, capacity, part) for part in SMALL_PARTS), key=lambda p: p.sequences)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces."""
    key = (table[:, 0] << 44) | table[:, 1]
    row = table[np.searchsorted(key, (length << 44) | rank, "right") - 1]
    k = rank - row[:, 1]
    return row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * length


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Sequences hold at most capacity tokens, without gaps from offset 0. A null text counts as
    empty: its end token alone. Null and repeated ids are packed like others. Ids are integers.
    Extra columns are ignored, whatever their names; an empty table gives no rows. The tokenizer's
    rank file is read on the executors from ranks_path, which every node must have.
    """
    spark = docs.sparkSession
    made = pieces(docs, id_col, text_col, ranks_path, pattern, capacity, with_ids)
    # Dealt by where a row lies, so that even equal rows spread; written, so that it stays so.
    cut_up = materialize(made.withColumn("lot", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(best_plan(counts, capacity).table())
    known = spark.createDataFrame([(n, -(-c // BUCKET)) for n, c in counts.items()], "length long, buckets long")
    dealt = cut_up.join(F.broadcast(known), "length").withColumn("bucket", F.pmod("lot", "buckets")).drop("buckets", "lot")
    sizes = materialize(dealt.groupBy("length", "bucket").count(), "sizes")
    # Counts before each bucket, by blocks of buckets: no length's buckets are summed in one task.
    block = F.floor(F.col("bucket") / BUCKET)
    each = sizes.withColumn("block", block)
    blocks = each.groupBy("length", "block").agg(F.sum("count").alias("count"))
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("length", "block", earlier.alias("earlier"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = each.withColumn("before", before).join(blocks, ["length", "block"]).select("length", "bucket", (F.col("before") + F.col("earlier")).alias("base"))
    place_in = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("place", place_in).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place")).drop("bucket", "place", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, o = place(plan.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.int64()), pa.array(o, pa.int64())], names=schema.names)

    columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank"]
    schema = ranked.select(*columns[:-1]).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*columns).mapInArrow(run, schema).withColumnRenamed("id", id_col)
