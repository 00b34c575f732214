"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: which words, word beginnings (so that inflected forms share a feature), pairs
of neighbours and pairs with one word between occur, each hashed to one of 2^BITS places, present
or not; in training, those of fewer than LEAST_ROWS texts are left out. FTRL-proximal keeps a learning rate for each
coordinate and sets weights to zero unless their summed gradients exceed the L1 strength, so a
model is a short list of (place, weight) that is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, encoded, materialize
from .hashing import LETTERS, chunks, mix, word_hashes

BITS = 20
#: Bounds on the training sample: labelled rows, taken by hash of their id, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 128 << 20
EPOCHS = 8
#: Bytes of word beginnings that are features of their own.
STEMS = (4, 6)
LEAST_ROWS = 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every word, beginning, bigram and skip-gram, repeats included."""
    h, bounds, *stems = word_hashes(texts, LETTERS, STEMS)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    docs, places = [doc] * (1 + len(stems)), [h, *stems]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x8CB92BA72F3D8DD7)):
            if len(h) > gap:
                same = doc[gap:] == doc[:-gap]
                docs.append(doc[gap:][same])
                places.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(docs), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    places: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        dense = np.zeros(1 << BITS)
        dense[self.places] = self.weights
        for a, b in chunks(texts):
            doc, place = features(texts[a:b])
            used = np.flatnonzero(dense[place])
            once = np.unique((doc[used] << BITS) | place[used])  # present or not
            z = np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], b - a) + self.bias
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def fit(texts: list[bytes], labels: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 20.0, l2: float = 0.0, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal, one text at a time, in an order drawn with a fixed seed."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the bias, without L1
    bias = 1 << BITS
    rows: list[np.ndarray] = []
    count = np.zeros(1 << BITS, np.int64)
    for a, b in chunks(texts, 1 << 19):
        doc, place = features(texts[a:b])
        once = np.unique((doc << BITS) | place)
        cuts = np.searchsorted(once, np.arange(1, b - a) << BITS)
        once &= (1 << BITS) - 1
        count += np.bincount(once, minlength=1 << BITS)
        rows += [x.copy() for x in np.split(once.astype(np.int32), cuts)]
    for k, x in enumerate(rows):
        rows[k] = np.append(x[count[x] >= LEAST_ROWS], np.int32(bias))
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            zi, ni = z[i], n[i]
            strength = np.full(len(i), l1)
            strength[-1] = 0
            w = np.where(np.abs(zi) <= strength, 0, -(zi - np.sign(zi) * strength) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -500, 500))) - labels[k]
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[i] = grown
    strength = np.full(len(z), l1)
    strength[-1] = 0
    w = np.where(np.abs(z) <= strength, 0, -(z - np.sign(z) * strength) / ((beta + np.sqrt(n)) / alpha + l2))
    places = np.flatnonzero(w[:-1])
    return Model(places, w[places], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most sample_rows labelled rows, chosen by hash of the id, until their texts
    have SAMPLE_BYTES; the ids (a bounded list) are broadcast to the texts. Of documents that share
    an id, one is learned from, that of the least text hash. Without labelled rows every score is
    one half."""
    some = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    some = materialize(some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample_rows), "labelled")
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")).join(F.broadcast(some.select("_id").distinct()), "_id", "left_semi")
    rows = texts.groupBy("_id").agg(F.min("t").alias("t")).join(F.broadcast(some), "_id")
    # At most sample_rows rows are left, so one window serves all.
    before = Window.orderBy(F.xxhash64("_id"), "_id", "_y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bytes", F.coalesce(F.sum(F.octet_length("t.text")).over(before), F.lit(0)))
    got = rows.filter(F.col("_bytes") < SAMPLE_BYTES).select("_id", F.col("t.text").alias("_text"), "_y").collect()
    got.sort(key=lambda r: (r["_id"], r["_y"], r["_text"] or ""))
    return fit(encoded([r["_text"] for r in got]), np.array([r["_y"] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), predicted (1 if score >= 0.5).

    A null text counts as empty and gets the bias alone. Null and repeated ids keep their rows;
    other columns are ignored, whatever their names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        s = sent.value.scores(encoded(texts))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return append_columns(docs, text_col, [id_col], "score double, predicted int", run)
