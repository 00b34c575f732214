"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

A file's sentences, its paragraphs and the whole text become sparse TF-IDF vectors of words and word
pairs and are compared by cosine with license notices and openings of license texts. Every part of
every file gets a vector, whatever it says. Document frequencies are those of all words and pairs of
all files, counted in PLACES hash buckets, so that the table that is broadcast has a fixed size. A
file named like a license file licenses its folder; a file without a license of its own inherits
from the nearest ancestor folder that has one, by an equi-join of folders with their ancestors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, bound_batches, encoded, materialize, sized
from .hashing import LETTERS, chunks, mix, word_hashes, word_starts

THRESHOLD = 0.5
#: Bits of the hash buckets of document frequencies.
PLACE_BITS = 18
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"

#: Notices by license, as people write them, and opening words of license texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_SENTENCE_END = re.compile(rb"[.](?=\s|\Z)|\n")
_PARAGRAPH_END = re.compile(rb"\n[ \t\r*#/]*\n")
_PAIR, _UNIT = np.uint64(0x632BE59BD9B4E019), np.uint64(0x9E3779B97F4A7C15)


def terms(h: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words and pairs of neighbours of each unit: term hash, unit, count. h: hashes of
    words in order; unit: which unit each belongs to, ascending."""
    with np.errstate(over="ignore"):
        same = unit[1:] == unit[:-1]
        h, unit = np.concatenate([h, mix(h[:-1] * _PAIR + h[1:])[same]]), np.concatenate([unit, unit[1:][same]])
        _, first, count = np.unique(mix(h ^ (unit.astype(np.uint64) * _UNIT)), return_index=True, return_counts=True)
    return h[first], unit[first], count


def place_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


class Matcher:
    """Templates as unit TF-IDF vectors; frequency: files that hold a term of each bucket."""

    def __init__(self, frequency: np.ndarray, files: int):
        n = len(TEMPLATES)
        h, bounds = word_hashes([t.encode() for _, t in TEMPLATES], LETTERS)
        h, unit, count = terms(h, np.repeat(np.arange(n), np.diff(bounds)))
        self.keys, at, own = np.unique(h, return_inverse=True, return_counts=True)
        # From all files and from the templates, so that words common to notices weigh little.
        self.from_files = np.log((files + 1) / (frequency + 1)) / np.log(files + 2)
        self.from_templates, self.other = np.log((n + 1) / (own + 1)), np.log(n + 1)
        w = (1 + np.log(count)) * (self.from_files[place_of(h)] + self.from_templates[at])
        self.weights = np.zeros((n, len(self.keys)))
        self.weights[unit, at] = w / np.sqrt(np.bincount(unit, w * w, n))[unit]

    def cosines(self, h: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
        """By template and unit."""
        h, unit, count = terms(h, unit)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        w = (1 + np.log(count)) * (self.from_files[place_of(h)] + np.where(known, self.from_templates[at], self.other))
        norm = np.sqrt(np.bincount(unit, w * w, units))
        at, unit, w = at[known], unit[known], w[known]
        return np.stack([np.bincount(unit, w * row[at], units) for row in self.weights]) / np.maximum(norm, 1e-300)

    def best(self, texts: list[bytes]) -> list[tuple[str | None, float | None, int | None, int | None]]:
        """(license, cosine, start, end) of each text's best part: the earliest of equals, then the
        shortest; code points. Nones if no part reaches the threshold."""
        out: list = [(None, None, None, None)] * len(texts)
        for a, b in chunks(texts):
            part = texts[a:b]
            h, bounds = word_hashes(part, LETTERS)
            starts, ends = word_starts(part, LETTERS)
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(part)), np.diff(bounds))
            shift = np.cumsum([0, *(len(t) + 1 for t in part)])[:-1]
            found = []  # document, cosine, first word, words, template
            for cut in (_SENTENCE_END, _PARAGRAPH_END, None):
                cuts = [] if cut is None else [m.end() + s for t, s in zip(part, shift.tolist(), strict=True) for m in cut.finditer(t)]
                unit = np.searchsorted(np.array(cuts, np.int64), starts, "right") + doc  # grows at cuts and texts
                first = np.flatnonzero(np.diff(unit, prepend=-1))
                unit = np.cumsum(np.diff(unit, prepend=-1) > 0) - 1
                c = self.cosines(h, unit, len(first))
                top = c.argmax(0)
                c = np.round(c[top, np.arange(len(first))], 9)
                good = np.flatnonzero(c >= THRESHOLD)
                size = np.diff(np.append(first, len(h)))
                found += zip(doc[first[good]].tolist(), (-c[good]).tolist(), first[good].tolist(), size[good].tolist(), top[good].tolist(), strict=True)
            seen = set()
            for d, c, first, size, top in sorted(found):
                if d not in seen:
                    seen.add(d)
                    s, e = int(starts[first] - shift[d]), int(ends[first + size - 1] - shift[d])
                    begin = len(part[d][:s].decode("utf-8", "replace"))
                    out[a + d] = (TEMPLATES[top][0], min(-c, 1.0), begin, begin + len(part[d][s:e].decode("utf-8", "replace")))
        return out


def fit(files: DataFrame, text_col: str = "text") -> Matcher:
    """Counts, over all files, how many hold a term of each bucket. Tasks add up their batches and
    give one row a bucket; the result has at most 2^PLACE_BITS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << PLACE_BITS, np.int64), 0
        for batch in batches:
            texts = encoded(batch.column(0).to_pylist())
            rows += len(texts)
            for a, b in chunks(texts):
                h, bounds = word_hashes(texts[a:b], LETTERS)
                h, doc, _ = terms(h, np.repeat(np.arange(b - a), np.diff(bounds)))
                held = np.unique(doc << PLACE_BITS | place_of(h)) & ((1 << PLACE_BITS) - 1)
                counts += np.bincount(held, minlength=1 << PLACE_BITS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], rows))], names=["place", "n"])

    bound_batches(files.sparkSession)
    summed = files.select(F.col(text_col).alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    frequency, total = np.zeros(1 << PLACE_BITS), 0
    got = summed.toArrow()
    place, n = got.column("place").to_numpy(), got.column("n").to_numpy()
    total = int(n[place < 0].sum())
    frequency[place[place >= 0]] = n[place >= 0]
    return Matcher(frequency, total)


def detect(files: DataFrame, matcher: Matcher, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, kept columns, license, score, start, end: the best notice of each whole text."""
    sent = files.sparkSession.sparkContext.broadcast(matcher)
    rows = files.select(F.col(path_col).alias("path"), *keep, F.col(text_col).alias("_text"))

    def run(texts: list[str | None]) -> list[pa.Array]:
        out = sent.value.best(encoded(texts))
        return [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))]

    return append_columns(rows, "_text", ["path", *keep], "license string, score double, start long, end long", run)


def folder(path):
    """What is before the last "/"; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of files: path, kept columns, license, score, start, end (the file's own
    notice), effective_license, inherited_from (the license file's path; null for own ones).

    A null text counts as empty; a null path inherits nothing. If a folder has several license
    files, the best score counts, then the smallest path. Repeated paths keep their rows; columns
    that aren't named are ignored; an empty table gives no rows.
    """
    found = materialize(detect(files, fit(files, text_col), path_col, text_col, keep), "notices").withColumn("_dir", folder(F.col("path")))
    licensed = found.filter(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull())
    best = F.min(F.struct((-F.col("score")).alias("score"), "path", "license")).alias("b")
    licensed = materialize(licensed.groupBy("_dir").agg(best).select(F.col("_dir").alias("above"), F.col("b.path").alias("_from"), F.col("b.license").alias("_license")), "folders")
    # Folders, not files, meet their ancestors; the nearest one is the longest.
    parts = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = found.filter("path is not null").select("_dir").distinct()
    near = folders.select("_dir", F.explode(F.array_distinct(up)).alias("above")).join(sized(licensed, 512), "above")
    near = near.groupBy("_dir").agg(F.max(F.struct(F.length("above").alias("n"), "_from", "_license")).alias("x")).select("_dir", "x._from", "x._license")
    rows = found.join(sized(materialize(near, "inherited"), 512), "_dir", "left")
    own = F.col("license").isNotNull()
    return rows.select("path", *keep, "license", "score", "start", "end", F.coalesce("license", "_license").alias("effective_license"), F.when(~own, F.col("_from")).alias("inherited_from"))
