"""Searches that skip blocks against full scoring, segments, and what they read."""

import random

import pytest
from pyspark.sql import functions as F

from wrenfold.operators import blocks, lexical
from wrenfold.operators.blocks import BlockIndex
from wrenfold.operators.lexical import Term

WEIGHTS = {"title": 10.0, "body": 1.0}
SCHEMA = "entry_id string, seq long, title string, body string, token string"
QUERIES = [
    [Term(("ab",), False)], [Term(("a",), True), Term(("bc",), False)], [Term(("c",), True), Term(("ab", "c"), True), Term(("bb",), False)],
    [Term(("ab", "bc"), False)], [Term(("zzz",), False)], [Term(("rare",), False), Term(("ab",), True)], [],
]


def made(n, seed=1, start=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(40)] + ["Rare"]
    weigh = [1 / (1 + k) for k in range(40)] + [0.01]
    text = lambda most: " ".join(rng.choices(words, weigh, k=rng.randint(0, most)))
    return [(f"e{start + i:05d}", start + i, text(4) if i % 9 else None, text(30), "x") for i in range(n)]


def full(spark, rows, terms, k):
    """The k best by scoring all."""
    live = spark.createDataFrame([(r[0], *r[2:4]) for r in rows], "id string, title string, body string")
    found = lexical.postings(live, tuple(WEIGHTS))
    total, mean = lexical.sizes(live, tuple(WEIGHTS))
    return [(r["id"], round(r["score"], 9)) for r in lexical.top(lexical.bm25(found, terms, WEIGHTS, total, mean), k).collect()]


def short(found):
    return [(i, round(s, 9)) for i, _, s in found.hits]


@pytest.fixture
def small(monkeypatch):
    """Rounds and size classes of a small test."""
    monkeypatch.setattr(blocks, "FIRST", 2)
    monkeypatch.setattr(blocks, "GROWTH", 2)
    monkeypatch.setattr(blocks, "SMALLEST", 50)


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_like_full_scoring(spark, tmp_path, small, k):
    rows = made(900)
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS)
    index.add(spark.createDataFrame(rows, SCHEMA).repartition(3), 1)
    for terms in QUERIES:
        assert short(index.search(terms, k)) == full(spark, rows, terms, k), terms


def test_blocks_are_skipped(spark, tmp_path):
    """A word that few records hold often: the blocks of the others are not scored."""
    rows = [(f"e{i}", i, "ab " * 5 if i < 40 else None, "ab " + "filler " * (20 + i % 7), "x") for i in range(20_000)]
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS)
    index.add(spark.createDataFrame(rows, SCHEMA).coalesce(2), 1)
    found = index.search([Term(("ab",), False)], 10)
    assert short(found) == full(spark, rows, [Term(("ab",), False)], 10)
    assert found.blocks >= 312 and found.scored_blocks <= 104 and found.postings == 20_000 and found.scored_postings <= 104 * 64


def test_replaced_and_deleted_rows(spark, tmp_path, small):
    first, second = made(300), made(200, seed=2, start=300)
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS)
    index.add(spark.createDataFrame(first, SCHEMA), 1)
    # a third of the first batch is written again, some rows twice within the batch
    again = [(r[0], 1000 + k, "Rare ab", r[3], "x") for k, r in enumerate(first[::3])]
    twice = [(r[0], 2000 + k, None, "bc bc", "x") for k, r in enumerate(again[:20])]
    gone = [(r[0], r[1]) for r in first[::3]] + [(r[0], r[1]) for r in again[:20]] + [(r[0], r[1]) for r in first[1:30:3]]
    index.add(spark.createDataFrame(second + again + twice, SCHEMA), 2, spark.createDataFrame(gone, "entry_id string, seq long"))
    dead = set(gone)
    live = [r for r in first + second + again + twice if (r[0], r[1]) not in dead]
    for terms in QUERIES:
        assert short(index.search(terms, 20)) == full(spark, live, terms, 20), terms
    index._merge(index.segments())
    assert index.segments() == ["1-2"] and index.totals() == lexical.sizes(spark.createDataFrame(live, SCHEMA), tuple(WEIGHTS))
    for terms in QUERIES[:4]:
        assert short(index.search(terms, 20)) == full(spark, live, terms, 20), terms
    assert index._read("records", blocks.RECORDS, ["1-2"]).count() == len(live)


def test_segments_stay_few(spark, tmp_path, small):
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS)
    rows, gone = [], []
    for batch in range(1, 14):
        new = made(12, seed=batch, start=100 * batch)
        late = [(r[0], 100 * batch + 50 + k, "ab", None, "x") for k, r in enumerate(rows[:2])]
        bad = [(r[0], r[1]) for r in rows[:2]]
        index.add(spark.createDataFrame(new + late, SCHEMA), batch, spark.createDataFrame(bad, "entry_id string, seq long"))
        index.compact()
        rows = rows[2:] + new + late
        assert len(index.segments()) <= 5 and index.batches() == list(range(1, batch + 1))
    for terms in QUERIES[:3]:
        assert short(index.search(terms, 10)) == full(spark, rows, terms, 10)
    assert len(list((tmp_path / "i").glob("segment=*"))) == len(index.segments()) and not list((tmp_path / "i").glob("draft*"))


def test_unfinished_segments_are_unseen(spark, tmp_path, small):
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS)
    assert index.search([Term(("ab",), False)], 5).hits == [] and index.segments() == []
    rows = made(60)
    for b in (1, 2, 3):
        index.add(spark.createDataFrame(rows[20 * b - 20 : 20 * b], SCHEMA), b)
    want = short(index.search([Term(("ab",), False)], 5))
    # a merge that stopped before its mark, and one that stopped before it removed what it covers
    (tmp_path / "i" / "segment=2-3").mkdir()
    assert index.segments() == ["1-1", "2-2", "3-3"]
    index._drop = lambda folder: None
    index._merge(["1-1", "2-2", "3-3"])
    assert index.segments() == ["1-3"] and short(index.search([Term(("ab",), False)], 5)) == want
    assert index.search([Term(("ab",), True)], 0).hits == []


def test_empty_rows(spark, tmp_path):
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS, stemmed=False, fold=False)
    index.add(spark.createDataFrame([], SCHEMA), 1)
    index.add(spark.createDataFrame([("a", 1, None, None, "x"), ("b", 2, "É b", "é", "x"), ("b", 2, "É b", "é", "x")], SCHEMA), 2)
    assert index.totals() == (3, 2.0)
    found = index.search([Term(("é",), False)], 5)
    assert [h[0] for h in found.hits] == ["b", "b"] and found.hits[0][2] == found.hits[1][2]


def test_no_text_and_few_columns_in_exchanges(spark, tmp_path):
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS)
    index.add(spark.createDataFrame(made(50), SCHEMA), 1)
    rows = index._read("blocks", blocks.BLOCKS, ["1-1"]).where(F.col("token") == "ab")
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,ab)]" in rows._jdf.queryExecution().toString()
