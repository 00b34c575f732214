"""MinHash near-dedup with SetSketch registers.

A document is its set of word shingles. Register i of a sketch is the smallest hash i of the set,
read as an exponential variable and truncated to an integer power of BASE (Ertl, SetSketch, 2021):
floor(1 - log_BASE(minimum)), kept within 0 and TOP. Such registers merge by maximum and agree
about as often as sets overlap. The steps:

1. One row a document: set size, set fingerprint, sketch. Documents of equal sets become one.
2. Bands of registers are bucket keys. In each bucket every member is paired with its smallest
   one (a star, so a hot bucket costs one row a member), never all with all.
3. Pairs are estimated jointly from all registers by likelihood, with the known set sizes, and
   those clearly below the threshold go. The rest is compared on full sets.
4. Links make components. A bucket whose members are now in one component is done. In each other
   bucket the pairs across components that no star has tested are compared block by block, on full
   sets inside one task, and only joining links leave it. This is complete: every pair that meets
   in a bucket is linked, rejected on its full sets (or far below by estimate), or already joined.

With 32 bands of 5 registers a pair of similarity 0.8 meets in no bucket with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, encoded, materialize, sized
from .components import connected_components
from .hashing import NOT_SPACE, chunks, mix, word_hashes

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Standard deviations of the estimate below the threshold at which a pair is dropped unverified. A
#: pair of similarity 0.8 has so few equal registers with probability 1.4e-8; with 4 it was 6.7e-5.
MARGIN = 6
#: Bounds on a block of an open bucket: members and bytes of full sets.
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20
#: Bound on the members of the largest component in a block, if a bucket has several blocks.
MAJOR_ROWS = 2048

_draw = np.random.default_rng(11)
_FLIP = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _draw.integers(0, 2, REGISTERS, dtype=np.uint64)
_TIMES = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: size words each, or all words if fewer."""
    for a, b in chunks(texts):
        h, bounds = word_hashes(texts[a:b], NOT_SPACE)
        with np.errstate(over="ignore"):
            wide = np.zeros(max(0, len(h) - size + 1), np.uint64)
            for k in range(size):
                wide = wide * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(wide)]
            wide = mix(wide)
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j - i >= size:
                    yield np.unique(wide[i : j - size + 1])
                elif j > i:
                    x = np.uint64(j - i)
                    for word in h[i:j]:
                        x = x * np.uint64(0xD6E8FEB86659FD93) + word
                    yield mix(np.array([x], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set; all 0 for an empty one."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), 2048):
            np.minimum(least, ((hashes[None, k : k + 2048] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=least)
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarities of pairs of sketches (rows of a and b) of sets of known sizes, by the largest
    joint likelihood of how many registers are greater, less and equal."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        return up * np.log(p) + down * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) >= likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _stack(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(-1, REGISTERS)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection is at least percent times the union of sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """n, f1, f2, sketch beside the columns of docs (id, text, others) but the text: a row per row."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        out = []
        for s in shingle_sets(encoded(texts), size):
            with np.errstate(over="ignore"):
                f1, f2 = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
            out.append((len(s), f1.astype(np.int64), f2.astype(np.int64), sketch(s).tobytes()))
        return [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]

    return append_columns(docs, "text", [c for c in docs.columns if c != "text"], "n long, f1 long, f2 long, sketch binary", run)


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, set (sorted 64-bit shingle hashes) of the documents with these ids."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([s.tobytes() for s in shingle_sets(encoded(texts), size)], pa.binary())]

    ids = materialize(ids.distinct(), "ids")
    return materialize(append_columns(docs.join(sized(ids, 16), "id", "left_semi"), "text", ["id"], "set binary", run), "sets")


def few_files(rows: DataFrame) -> DataFrame:
    """rows dealt anew by size: many tasks keep few of their rows, and each file written costs a
    commit and, on local disks without Hadoop's native library, processes (chmod)."""
    return rows.hint("rebalance")


def bands(reps: DataFrame) -> DataFrame:
    """key, rep: a row for each band of each sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with np.errstate(over="ignore"):
                keys = (_stack(batch["sketch"]) * _BAND).reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            yield pd.DataFrame({"key": mix(keys).astype(np.int64).ravel(), "rep": np.repeat(batch["rep"].to_numpy(), BANDS)})

    return reps.select("rep", "sketch").mapInPandas(run, "key long, rep long")


def probable(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that sizes and the joint estimate leave possible."""
    a = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sure = least_estimate(percent / 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.loc[estimate(_stack(x["sa"]), _stack(x["sb"]), x["na"].to_numpy(), x["nb"].to_numpy()) >= sure, ["a", "b"]]

    joined = pairs.join(a, "a").join(b, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those similar on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x["sa"], x["sb"], strict=True)]
            yield x.loc[good, ["a", "b"]]

    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long")


def joins_in_block(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links across components among a block's rows (rep, label, pivot, side, sketch, set): each
    pair of the two sides (or of the one) that has no smaller common band and isn't a star's."""
    block = block.sort_values("rep", ignore_index=True)
    regs, sets = _stack(block["sketch"]), [np.frombuffer(s, np.uint64) for s in block["set"]]
    n, rep, pivot = np.array([len(s) for s in sets]), block["rep"].to_numpy(), block["pivot"].iloc[0]
    label = {x: x for x in block["label"]}
    own = block["label"].to_numpy()
    side = block["side"].to_numpy()
    halves = len(np.unique(side)) > 1
    least = least_estimate(percent / 100)
    band = int(block["band"].iloc[0])

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    found = []
    for at in range(0, len(block), 32):
        rows = np.arange(at, min(at + 32, len(block)))
        can = (rows[:, None] < np.arange(len(block))) & (own[rows][:, None] != own) & (rep[rows] != pivot)[:, None] & (rep != pivot)
        can &= 100 * np.minimum(n[rows][:, None], n) >= percent * np.maximum(n[rows][:, None], n)
        if halves:
            can &= side[rows][:, None] != side
        i, j = np.nonzero(can)
        for part in range(0, len(i), 1 << 14):
            p, q = rows[i[part : part + (1 << 14)]], j[part : part + (1 << 14)]
            same = regs[p] == regs[q]
            some = np.flatnonzero(same.mean(1) >= least - 0.05)
            some = some[same[some].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
            some = some[estimate(regs[p[some]], regs[q[some]], n[p[some]], n[q[some]]) >= least]
            for x, y in zip(p[some], q[some], strict=True):
                r, s = root(own[x]), root(own[y])
                if r != s and similar(sets[x], sets[y], percent):
                    label[max(r, s)] = min(r, s)
                    found.append((rep[x], rep[y]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, with_key: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable over pairs
    whose sets of size-word shingles have 100 * intersection >= percent * union), kept.

    Words are what white space separates, A-Z lower-cased. A text of fewer words is one shingle; a
    null or blank text is empty and linked with nothing. Rows that share an id are one node. A row
    with a null id is linked with nothing, has a null component_id and is kept. Ids are integers.
    Other columns are ignored, whatever their names; an empty table gives no rows. If asked,
    text_key (the text's 64-bit hash) tells rows of an id apart.
    """
    text_key = ["text_key"] if with_key else []
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.xxhash64(text_col).alias(c) for c in text_key))
    drawn = materialize(sketches(docs, size), "sketches")
    known = drawn.filter("n > 0 and id is not null")
    reps = known.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "sketch")).alias("r")).select("f1", "f2", "n", F.col("r.id").alias("rep"), F.col("r.sketch").alias("sketch"))
    reps = materialize(reps, "reps")

    keyed = bands(reps)
    buckets = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).filter("c > 1")
    members = materialize(few_files(keyed.join(buckets, "key")), "members")
    star = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    possible = materialize(few_files(probable(star, reps, percent)), "pairs")
    sets = full_sets(docs, possible.select("a").union(possible.select("b")).toDF("id"), size)
    links = materialize(few_files(confirmed(possible, sets, percent)), "links")
    labels = connected_components(links)

    placed = members.filter("c > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    placed = materialize(few_files(placed), "placed")
    weight = placed.join(reps.groupBy("rep").agg((F.max("n") * 8).alias("bytes")), "rep")
    parts = weight.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    major = F.max(F.struct("rows", "label", "bytes"))
    open_ = parts.groupBy("key").agg(major.alias("m"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).filter("parts > 1")

    def blocks(rows: Column, most: int, size: Column) -> Column:
        return F.greatest(F.ceil(rows / most), F.ceil(size / BLOCK_BYTES)).cast("int")

    rest, largest = blocks(F.col("rows") - F.col("m.rows"), BLOCK_ROWS, F.col("bytes") - F.col("m.bytes")), blocks(F.col("m.rows"), MAJOR_ROWS, F.col("m.bytes"))
    one = (F.col("rows") <= BLOCK_ROWS) & (F.col("bytes") <= BLOCK_BYTES)  # one block holds all
    open_ = open_.select("key", F.when(~one, F.col("m.label")).alias("major"), F.when(one, 1).otherwise(rest).alias("rest"), F.when(one, 0).otherwise(largest).alias("largest"))
    crowd = placed.join(open_, "key").withColumn("is_major", F.coalesce(F.col("label") == F.col("major"), F.lit(False)))
    crowd = crowd.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("is_major"), F.col("largest")).otherwise(F.col("rest"))).cast("int"))
    crowd = materialize(crowd.drop("major"), "open")
    more = materialize(cross_links(docs, crowd, reps, size, percent), "more")
    if not more.isEmpty():
        labels = connected_components(more.union(labels))

    groups = reps.select("f1", "f2", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("label", "rep").alias("label"))
    rows = drawn.select("id", *text_key, "n", "f1", "f2").join(groups, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return rows.select(F.col("id").alias(id_col), *text_key, F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def cross_links(docs: DataFrame, crowd: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Joining links inside open buckets. The blocks of all but the largest component meet two by
    two, and each meets the blocks of the largest one; each pair of blocks has a task of its own, so
    that no bucket is gathered whole."""
    if crowd.isEmpty():
        return crowd.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    sets = full_sets(docs, crowd.select(F.col("rep").alias("id")), size).withColumnRenamed("id", "rep")
    drawn = reps.select("rep", "sketch")
    own = F.col("block")

    def meets(count: str, kind: int, i: Callable[[Column], Column], j: Callable[[Column], Column], side: Column) -> Column:
        one = lambda o: F.struct(F.lit(kind).alias("kind"), i(o).alias("i"), j(o).alias("j"), side.alias("side"))
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(count) - 1, F.lit(0))), one)).otherwise(F.array())

    among = meets("rest", 0, lambda o: F.least(own, o), lambda o: F.greatest(own, o), own)
    across = meets("largest", 1, lambda o: own, lambda o: o, F.lit(0))
    met = F.when(F.col("is_major"), meets("rest", 1, lambda o: o, lambda o: own, F.lit(1))).otherwise(F.concat(among, across))
    met = crowd.select("key", "rep", "label", "pivot", F.inline(met)).join(drawn, "rep").join(sets, "rep")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        kind, i, j = (int(block[c].iloc[0]) for c in ("kind", "i", "j"))
        if (kind or i != j) and block["side"].nunique() < 2:  # the other block is empty
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        with np.errstate(over="ignore"):
            first = (_stack(block["sketch"].iloc[:1]) * _BAND).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        block["band"] = int(np.flatnonzero(mix(first).astype(np.int64) == block["key"].iloc[0])[0])
        return joins_in_block(block, percent)

    return met.groupBy("key", "kind", "i", "j").applyInPandas(run, "a long, b long").distinct()
