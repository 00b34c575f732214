"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a variable-order context tree: for every context of up to ``order`` bytes the
counts of the bytes that followed it in training. A text's code length under a language is exact
for these frozen counts: the longest known context predicts the byte with count / (total +
distinct); an unseen byte costs the escape distinct / (total + distinct) and goes on with the next
shorter context, down to 8 bits for any byte. Symbols that a longer context ruled out are not
excluded from shorter ones. The language with the shortest code wins. If asked, a text is rejected
whose code is longer, by more than REJECT_BITS, than one that knows no language: byte frequencies of
all languages together, or 8 bits a byte. For this the language may change with every SEGMENT bytes,
each change at its price, so that texts in several learned languages stay.

A byte's cost depends on at most order + 1 bytes. So a batch of texts is turned into n-gram codes,
costs are worked out once per distinct n-gram, and gathered: whole texts, no Python loop per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns

#: Longest context in bytes.
ORDER = 3
#: Bounds on the training sample: rows per language, taken by hash of id and text, and their bytes.
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 300, 8 << 20
#: Bound on the languages of the sample: those with most rows.
LANGUAGES = 1000
#: A text is rejected if knowing no language is 2^16 times as likely.
REJECT_BITS = 16
SEGMENT = 32
#: Bytes that are scored at once.
WINDOW = 1 << 20
UNDETERMINED = "und"


def ngrams(data: np.ndarray, order: int) -> np.ndarray:
    """For each place from order on: the last order + 1 bytes as one number."""
    out = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k : len(data) - order + k]
    return out


@dataclass
class Tree:
    """levels[k]: for contexts of k bytes, (grams, counts) of k + 1 bytes and (contexts, totals,
    distinct symbols), both sorted."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def grown(cls, texts: list[bytes], order: int) -> Tree:
        data = np.frombuffer(b"".join(bytes(order) + t for t in texts), np.uint8)
        first = np.zeros(len(data), bool)  # the padding before a text isn't predicted
        at = np.cumsum([0, *(len(t) + order for t in texts[:-1])]).astype(np.int64)
        for k in range(order):
            first[at + k] = True
        grams = ngrams(data, order)[~first[order:]]
        levels = []
        for k in range(order + 1):
            g, n = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            c, where = np.unique(g >> np.uint64(8), return_inverse=True)
            levels.append((g, n, c, np.bincount(where, n, len(c)), np.bincount(where, minlength=len(c))))
        return cls(levels)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte after the bytes before it."""
        cost, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        for k in range(len(self.levels) - 1, -1, -1):
            g, n, c, total, distinct = self.levels[k]
            if not len(g):
                continue
            own = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            context = own >> np.uint64(8)
            i = np.minimum(np.searchsorted(c, context), len(c) - 1)
            known = open_ & (c[i] == context)
            j = np.minimum(np.searchsorted(g, own), len(g) - 1)
            seen = known & (g[j] == own)
            cost += np.where(seen, np.log2((total[i] + distinct[i]) / n[j]), np.where(known, np.log2((total[i] + distinct[i]) / distinct[i]), 0))
            open_ &= ~seen
        return cost + 8 * open_


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    order: int
    background: Tree | None = None  # byte frequencies of all languages together

    def code_lengths(self, texts: list[bytes], trees: list[Tree] | None = None, segment: int | None = None) -> np.ndarray:
        """Bits by language (or given tree) and text; with segment, by piece of so many bytes of each
        text, text after text (the first piece begins ``order`` bytes before its text)."""
        trees = self.trees if trees is None else trees
        order, pad = self.order, bytes(self.order)
        data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        starts = np.cumsum([0, *(len(t) + order for t in texts)]).astype(np.int64)[:-1]
        padding = (starts[:, None] + np.arange(order)).ravel()
        if segment:
            starts = np.concatenate([np.arange(s, s + order + len(t), segment) for s, t in zip(starts, texts, strict=True)])
        out = np.zeros((len(trees), len(starts)))
        for begin in range(order, len(data), WINDOW):
            end = min(begin + WINDOW, len(data))
            codes, distinct = pd.factorize(ngrams(data[begin - order : end].astype(np.uint64), order))
            inside = padding[np.searchsorted(padding, begin) : np.searchsorted(padding, end)] - begin
            a, b = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end - 1, "right")
            parts = np.maximum(starts[a:b], begin) - begin
            for k, tree in enumerate(trees):
                cost = tree.bits(distinct)[codes]
                cost[inside] = 0
                out[k, a:b] += np.add.reduceat(cost, parts)
        return out

    def predict(self, texts: list[bytes], reject: bool = False) -> tuple[list[str], np.ndarray]:
        """The language with the shortest code (of equals, the first by name), and its posterior
        probability if all languages are as likely beforehand. With reject, und and 0 for texts
        that no language explains."""
        if reject:
            pieces = [-(-(self.order + len(t)) // SEGMENT) for t in texts]
            first = np.cumsum([0, *pieces])[:-1]
            parts = self.code_lengths(texts, [*self.trees, self.background], SEGMENT)
            bits, plain = np.add.reduceat(parts[:-1], first, 1), np.add.reduceat(parts[-1], first)
            mixed = np.add.reduceat(parts[:-1].min(0) + np.log2(len(self.trees)), first)
        else:
            bits = self.code_lengths(texts)
        best, least = bits.argmin(0), bits.min(0)
        names, p = [self.languages[k] for k in best], 1 / np.exp2(np.maximum(least - bits, -1000)).sum(0)
        if reject:
            good = np.minimum(least, mixed) <= np.minimum(plain, [8 * len(t) for t in texts]) + REJECT_BITS
            names, p = [n if g else UNDETERMINED for n, g in zip(names, good, strict=True)], np.where(good, p, 0)
        return names, p


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int) -> list:
    """At most so many rows of each language, by hash of id and text. A first cut by each
    language's count keeps the ranked rows few, whatever language holds most of them."""
    h = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 32))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), h.alias("_h")).filter("_text is not null and _lang is not null")
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES).collect()}
    picked = []
    for lang in sorted(counts):
        cut = min(1.0, 3 * rows_per_language / counts[lang] + 1e-6) * (1 << 32)
        picked.append((F.col("_lang") == lang) & (F.col("_h") < int(cut)))
    if not picked:
        return []
    some = picked[0]
    for p in picked[1:]:
        some = some | p
    order = Window.partitionBy("_lang").orderBy("_h", "_id", F.xxhash64("_text"))
    ranked = rows.filter(some).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows_per_language)
    before = F.coalesce(F.sum(F.octet_length("_text")).over(Window.partitionBy("_lang").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("_bytes", before).filter(F.col("_bytes") < BYTES_PER_LANGUAGE).select("_lang", "_text").orderBy("_lang", "_rank").collect()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from whole texts of rows with a text and a language; the caller leaves out others."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in training_sample(docs, id_col, text_col, lang_col, rows_per_language):
        texts.setdefault(lang, []).append(text.encode("utf-8", "replace"))
    names = sorted(texts)
    return Model(names, [Tree.grown(texts[n], order) for n in names], order, Tree.grown([t for n in names for t in texts[n]], 0))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, reject: bool = False) -> DataFrame:
    """One row per row of docs: id (or the columns in keep), lang_pred, score.

    A text that is null or has no letter gives ``und`` and 0, as does every text if the model has
    no language, and with reject a text that no language explains.
    Of languages with equal codes, the first by name is taken. Null and repeated ids keep their rows; other columns are ignored, whatever their
    names; an empty table gives no rows. Whole texts are scored, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [id_col] if keep is None else keep
    rows = docs.select(*keep, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_lettered"))

    def score(texts: list[str | None]) -> list[pa.Array]:
        model = sent.value
        lang, p = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        some = [k for k, t in enumerate(texts) if t is not None] if model.languages else []
        if some:
            lang[some], p[some] = model.predict([texts[k].encode("utf-8", "replace") for k in some], reject)
        return [pa.array(lang, pa.string()), pa.array(p)]

    return append_columns(rows, "_lettered", keep, "lang_pred string, score double", score)
