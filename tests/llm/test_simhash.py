"""Fingerprints, the trie walk and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from wrenfold.llm import queries, simhash


def brute_fingerprint(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(keys, limit):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys[i] ^ keys) <= limit):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def planted(seed, groups=25, each=20, bits=9):
    rng = np.random.default_rng(seed)
    keys = []
    for base in rng.integers(0, 2**64, groups, dtype=np.uint64):
        for _ in range(each):
            x = base
            for p in rng.integers(0, 64, rng.integers(0, bits)):
                x ^= np.uint64(1) << np.uint64(p)
            keys.append(x)
    return np.unique(np.array(keys, np.uint64))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "A b C", "é É " * 40, "x " * 70000, "the cat sat\x0bon the mat\u00a0x"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("limit", range(8))
def test_links_and_components(spark, monkeypatch, limit):
    keys = planted(limit)
    want = brute_groups(keys, limit)
    groups = {}
    for k, g in zip(keys.view(np.int64).tolist(), want, strict=True):
        groups.setdefault(g, []).append(k)
    expected = {k: min(v) for v in groups.values() if len(v) > 1 for k in v}
    df = spark.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "fp long")
    for rows, chunk in ((32, 8), (32, 1 / 16)):
        monkeypatch.setattr(simhash, "NODE_ROWS", rows)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, limit)).collect()}
        assert got == expected


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5, 7, 9])
def test_a_part_stays_within_its_budget(limit):
    n, width, first = simhash.parts(limit)
    rng = np.random.default_rng(limit)
    for _ in range(2000):
        bits = rng.choice(64, limit, replace=False)
        assert min(np.sum((bits >= width * k) & (bits < width * (k + 1))) for k in range(n)) <= first


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    keys = np.array([brute_fingerprint(d["text"]) for d in docs], np.uint64)
    want = brute_groups(keys, 3)
    least = {}
    for d, g in zip(docs, want, strict=True):
        least[g] = min(d["doc_id"], least.get(g, d["doc_id"]))
    expected = {d["doc_id"]: (f"{int(k):016x}", least[g]) for d, k, g in zip(docs, keys, want, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_near_dedup(spark, SMALL).collect()}
    assert got == expected


def test_edges(spark):
    rows = spark.createDataFrame([(5, None, "x"), (3, "", "x"), (None, " ", "x"), (9, "a b c d e", "x"), (9, "a b c d e", "x"), (None, "zz yy xx ww", "x")], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(rows).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (5, 3), (9, 9), (9, 9)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
