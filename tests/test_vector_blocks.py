"""Vector searches that skip blocks against scoring all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenfold.operators import vector_blocks
from wrenfold.operators.vector_blocks import VectorIndex

SCHEMA = "entry_id string, seq long, project_scope string, tags array<string>, embedding array<float>, block string"


def made(n, seed, start=0, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = (centres[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, width))).astype(np.float32)
    return [(f"e{start + i}", start + i, "ab"[i % 2] if i % 5 else None, ["x"] if i % 3 else ["Y", "x"], v.tolist(), "z") for i, v in enumerate(x)]


def brute(rows, q, k, floor, scope=None, tag=None):
    some = [r for r in rows if r[4] and len(r[4]) == len(q) and (scope is None or r[2] == scope) and (tag is None or tag in r[3])]
    scored = [(r[0], float(np.dot(np.array(r[4], np.float64), q))) for r in some]
    return sorted([s for s in scored if s[1] >= floor], key=lambda s: (-s[1], s[0]))[:k]


def short(found):
    return [(i, round(s, 6)) for i, _, s in found.hits]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", 32)
    monkeypatch.setattr(vector_blocks, "FIRST", 2)
    monkeypatch.setattr(vector_blocks, "GROWTH", 2)


def test_like_scoring_all(spark, tmp_path, small):
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    assert index.search([1.0], 5, 0.0).hits == []
    first, second = made(1500, 1), made(300, 2, start=1500)
    odd = [("none", 1, None, [], [], "z"), ("wide", 2, "a", [], [1.0] * 9, "z"), ("bad", 3, "a", [], [float("nan")] * 8, "z"), ("twin", 4, "a", ["x"], first[7][4], "z"), ("twin", 4, "a", ["x"], first[7][4], "z")]
    none = spark.createDataFrame([], "entry_id string, seq long")
    index.add(spark.createDataFrame(first + odd, SCHEMA).repartition(3), 1, none)
    gone = [(r[0], r[1]) for r in first[::4]]
    index.add(spark.createDataFrame(second, SCHEMA), 2, spark.createDataFrame(gone, "entry_id string, seq long"))
    index.add(spark.createDataFrame([], SCHEMA), 3, none)
    live = [r for r in first + odd + second if (r[0], r[1]) not in set(gone) and not np.isnan(np.array(r[4])).any()]
    skipped = 0
    for k, q in enumerate(np.random.default_rng(5).normal(size=(4, 8)).tolist()):
        for some, floor, scope, tag in ((7, -99.0, None, None), (5, 0.35, "a", None), (2000, 0.0, "b", "Y"))[: 1 + 2 * (k == 0)]:
            found = index.search(q, some, floor, scope, [tag] if tag else [])
            assert short(found) == [(i, round(s, 6)) for i, s in brute(live, q, some, floor, scope, tag)]
            skipped += some == 7 and found.scored_blocks <= found.blocks // 2
    assert skipped >= 3  # most of the blocks are not read for a few neighbours
    q = first[7][4]
    assert short(index.search(q, 3, 0.0)) == [(i, round(s, 6)) for i, s in brute(live, q, 3, 0.0)]


def test_unmarked_batches_are_unseen(spark, tmp_path, small):
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    none = spark.createDataFrame([], "entry_id string, seq long")
    index.add(spark.createDataFrame(made(40, 1), SCHEMA), 1, none)
    index.add(spark.createDataFrame(made(40, 2, 40), SCHEMA), 2, none)
    (tmp_path / "v" / "batch=2" / "_WHOLE").unlink()
    assert index.batches() == [1] and all(s < 40 for _, s, _ in index.search([1.0] * 8, 80, -99.0).hits)
    index.add(spark.createDataFrame(made(40, 2, 40), SCHEMA), 2, none)
    assert len(index.search([1.0] * 8, 80, -99.0).hits) == 80
    plan = index._read("bounds", vector_blocks.BOUNDS).where(F.col("width") == 8)._jdf.queryExecution().toString()
    assert "embedding" not in plan
