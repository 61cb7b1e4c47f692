"""The pipeline's near duplicates against brute-force Jaccard of five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from wrenfold.llm import jaccard


def brute_shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_copies(seed=3):
    """Groups of a text and copies of it with 1 to 15 of 300 words changed, and unrelated texts that share a passage."""
    rng = np.random.default_rng(seed)
    passage = " ".join(f"common{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"x{k}y{i}" for i in range(200)) for k in range(15)]
    for g in range(20):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for p in rng.integers(0, 300, rng.integers(1, 16)):
                copy[p] = f"n{rng.integers(0, 10**9)}"
            texts.append(" ".join(copy))
    return texts


def brute_kept(texts):
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if len(a & b) / len(a | b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


@pytest.mark.parametrize("chunk", [2048, 2])
def test_recall_is_whole(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = near_copies()
    want = brute_kept(texts)
    assert 35 <= len(want) < len(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()} == want


def test_compare():
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 100), (0, 80), (0, 79), (11, 111), (12, 112), (500, 501))]
    got = jaccard.compare(sets, None, 0.8)
    assert got[0] == got[1] == got[2] == got[3] == got[4] != got[5]  # 80 of 100 is just enough, 79 comes in by 80, and 89 of 111 over 100
    got = jaccard.compare(sets[:3], np.array([False, True, True]), 0.8)
    assert got[0] == got[1] != got[2]


def test_edges(spark):
    rows = spark.createDataFrame([(5, None, "x"), (3, "", "x"), (None, " ", "x"), (9, "a b c d e", "x"), (9, "A b c d e", "x"), (None, "zz yy xx ww", "x")], "doc_id long, text string, set string")
    kept = jaccard.one_of_each(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "zz yy xx ww"), (3, ""), (9, "A b c d e")]
    assert jaccard.one_of_each(rows.limit(0)).count() == 0
