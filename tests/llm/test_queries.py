"""The opN queries and the pipeline on sf0.001 and sf0.01: SQL where there is any, else brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import queries as Q

from ..oracle import connection, same

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert same(spark, SF, Q.QUERIES[name], Q.ORACLE_SQL[name], connection(SF)) == 1000


def shingle_sets(rows, size):
    out = {}
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[k] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def brute_components(sets):
    """All pairs that share a shingle of the necessary prefix, checked exactly."""
    df = collections.Counter(x for s in sets.values() for x in s)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = collections.defaultdict(list)
    for k, s in sorted(sets.items(), key=lambda x: len(x[1])):
        rare = sorted(s, key=lambda x: (df[x], x))
        for x in rare[: len(s) - math.ceil(0.8 * len(s)) + 1]:
            for other in seen[x]:
                both = len(s & sets[other])
                if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                    a, b = root(k), root(other)
                    parent[max(a, b)] = min(a, b)
            seen[x].append(k)
    return {k: root(k) for k in sets}


def test_near_dedup_equals_brute_force(spark, docs):
    sets = shingle_sets([(d["doc_id"], d["text"]) for d in docs], 4)
    want = {k: (len(sets[k]), c, c == k) for k, c in brute_components(sets).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in Q.op1_near_dedup(spark, SF).collect()}
    assert got == want


def plain_pii(text):
    """(start, kind, end) by the patterns as the contract writes them."""

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", SF])
def test_pii_equals_patterns_and_tagger_on_every_row(spark, folder):
    """Base spans, counts and digests of all rows. In the smaller table also the other spans: the
    tagger's, decoded text by text with a plain Viterbi pass."""
    from tessera.llm import pii

    from .test_pii import plain_viterbi

    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in Q.op2_pii(spark, folder).collect()}
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    model, names = pii.tagger(), ("email", "ip", "card", "phone")
    for d in docs:
        r, text = got[d["doc_id"]], d["text"] or ""
        base = plain_pii(text)
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        if folder == SF:
            assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
            continue
        scores, _ = pii.emissions([text], model)
        tags = plain_viterbi(scores, model.weights["m"])
        more = []
        for k in range(1, 5):
            for run in re.finditer(f"{k}+", "".join(map(str, tags))):
                value = text[run.start() : run.end()]
                s = run.start() + len(value) - len(value.lstrip())
                e = s + len(value.strip())
                if pii._fits(k - 1, value.strip()) and all(e <= x[0] or s >= x[2] for x in base):
                    more.append((s, k - 1, e))
        assert r["spans"] == ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(base + more))


def test_html_text_equals_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op3_html_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("</?[a-z][^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(dict)
    sequences = collections.defaultdict(list)
    for r in Q.op4_packing(spark, SF).collect():
        pieces[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = 0
    for d in docs:
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = [pieces[d["doc_id"]][k] for k in range(len(pieces[d["doc_id"]]))]
        assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)]).tolist()[:-1]
        assert sum(p["length"] for p in own) == len(ids) and all(p["length"] == 2048 for p in own[1:])
        assert [p["ids_crc32"] for p in own] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own]
    assert len(sequences) <= 1.005 * -(-total // 2048)


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in Q.op5_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    hit = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    false = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert sum(hit) >= 0.8 * len(hit) and sum(false) <= 0.01 * len(false)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_language_on_held_out_rows(spark, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = [r for r in Q.op9_language_id(spark, SF).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.99 * len(rows)


def test_licenses_found_and_inherited(spark, docs):
    names = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "GNU General Public License, version 3": "GPL-3.0", "Apache License, Version 2.0": "Apache-2.0", "MIT License": "MIT"}
    text = {d["doc_id"]: d["text"] for d in docs}
    found = {r["doc_id"]: r for r in Q.op6_licenses(spark, SF).collect()}
    for k, r in found.items():
        want = next((v for n, v in names.items() if n in text[k]), None)
        assert r["license"] == want
    folders = {}
    for r in found.values():
        if "/LICENSE-" in r["path"] and r["license"]:
            key = (-r["score"], r["path"], r["license"])
            d = r["path"].rsplit("/", 1)[0]
            folders[d] = min(folders.get(d, key), key)
    for r in found.values():
        near = folders.get(r["path"].rsplit("/", 1)[0])
        assert r["effective_license"] == (r["license"] or (near and near[2]))


def test_pipeline_equals_brute_force(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near-dedup", "decontamination", "best-fit packing"]
    rows = [(d["doc_id"], d["text"]) for d in docs if any(c.isalpha() for c in d["text"])]
    best = {}
    for k, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), k))
    rows = [(k, t) for k, t in rows if best[re.sub(r"[\x20\x09-\x0D]", "", t)][1] == k]
    component = brute_components(shingle_sets(rows, 5))
    rows = [(k, t) for k, t in rows if component[k] == k]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {k for k, t in rows if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == clean
