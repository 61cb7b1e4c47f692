"""Stemmed, prefixed and phrased keyword scores against SQLite's full-text index, and Porter's examples."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from wrenfold.functions.stemming import stem
from wrenfold.operators import lexical
from wrenfold.schema import WEIGHTS

WORDS = "running runs runner relational conditional hopping café Café naive database db_pool timeout timeouts the of and lock locking locked pool ERROR e0382 42 zürich".split()
COLUMNS = tuple(WEIGHTS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    return [(f"{i:03d}", *[text(12) for _ in COLUMNS]) for i in range(150)]


@pytest.mark.parametrize("query", ["running", "timeouts lock", "db_pool", "relat condition", "zzz", "Lock the_of cafe", "e0382 42"])
def test_like_fts5(spark, corpus, query):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, {', '.join(COLUMNS)}, tokenize='porter unicode61')")
    con.executemany(f"INSERT INTO f VALUES ({', '.join('?' * (len(COLUMNS) + 1))})", corpus)
    rows = spark.createDataFrame(corpus, ["id", *COLUMNS])
    terms = lexical.terms_of(spark, query)
    total, mean = lexical.sizes(rows, COLUMNS)
    ours = {r["id"]: r["score"] for r in lexical.bm25(lexical.postings(rows, COLUMNS), terms, WEIGHTS, total, mean).collect()}
    from wrenfold.functions.textops import query_terms

    raw = spark.range(1).select(F.explode(query_terms(F.lit(query))).alias("t")).select("t.*").collect()
    match = " OR ".join(f'"{r["term"]}"' + ("*" if r["prefix"] else "") for r in raw)
    weights = ", ".join(str(WEIGHTS[c]) for c in COLUMNS)
    theirs = dict(con.execute(f"SELECT id, bm25(f, 0, {weights}) FROM f WHERE f MATCH ?", (match,)).fetchall())
    assert ours.keys() == theirs.keys()
    assert all(abs(ours[k] - theirs[k]) < 1e-9 for k in ours)


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"),
     ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"),
     ("electriciti", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("café", "café")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_kept_postings(spark, corpus, tmp_path):
    rows = spark.createDataFrame(corpus, ["id", *COLUMNS])
    made = lexical.postings(rows, COLUMNS)
    kept = lexical.keep(made, str(tmp_path / "p"))
    assert kept.count() == made.count()
    terms = lexical.terms_of(spark, "lock")
    total, mean = lexical.sizes(rows, COLUMNS)
    a, b = ({r["id"]: r["score"] for r in lexical.bm25(p, terms, WEIGHTS, total, mean).collect()} for p in (made, kept))
    assert a == b


def test_stems_begin_like_their_words():
    """What narrows words before stemming loses none, for made-up words with every ending that the rules know."""
    rng = random.Random(1)
    ends = "sses ies ss s eed ed ing at bl iz y ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti bility icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize e ll ability ibility".split()
    for _ in range(40_000):
        word = "".join(rng.choice("aeioubstlyvcz") for _ in range(rng.randint(0, 5))) + "".join(rng.choices(ends, k=rng.randint(0, 3)))
        root = stem(word)
        for k in range(1, len(root) + 1):
            assert word.startswith(lexical._begins(root[:k], True)), (word, root[:k])


@pytest.mark.parametrize("query", ["running timeouts lock", "db_pool the_of", "relat cafe", "zzz"])
def test_postings_of_terms_alone(spark, corpus, query):
    rows = spark.createDataFrame(corpus, ["id", *COLUMNS])
    terms = lexical.terms_of(spark, query)
    total, mean = lexical.sizes(rows, COLUMNS)
    score = lambda found: {r["id"]: r["score"] for r in lexical.bm25(found, terms, WEIGHTS, total, mean).collect()}
    assert score(lexical.postings(rows, COLUMNS, terms=terms)) == score(lexical.postings(rows, COLUMNS))
