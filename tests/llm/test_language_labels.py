"""Labels, shares and switches of the language query against forward-backward in logarithms, a text at a time."""

import math

import numpy as np
import pytest
from conftest import SMALL

from wrenfold.llm import language_id, queries


def log_sum(xs):
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def by_hand(scores, moves):
    """Each word's probabilities of the languages: scores of words, then of neighbours."""
    n, k = len(scores), len(moves)
    ahead, behind = [scores[0]], [[0.0] * k]
    for s in scores[1:]:
        ahead.append([s[y] + log_sum([ahead[-1][x] + moves[x][y] for x in range(k)]) for y in range(k)])
    for s in reversed(scores[1:]):
        behind.append([log_sum([moves[x][y] + s[y] + behind[-1][y] for y in range(k)]) for x in range(k)])
    behind.reverse()
    total = log_sum(ahead[-1])
    return [[math.exp(ahead[t][y] + behind[t][y] - total) for y in range(k)] for t in range(n)]


def labelled(text, model, known):
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0, 0
    words = language_id.split(text)
    for w in words:
        if w not in known:
            known[w] = [float(x) for x in model.emissions([w])[0]]  # a word's score depends on no other word
    p = by_hand([known[w] for w in words], model.moves.tolist())
    share = [sum(row[y] for row in p) / len(p) for y in range(len(model.languages))]
    best = [row.index(max(row)) for row in p]
    return model.languages[share.index(max(share))], max(share), sum(a != b for a, b in zip(best, best[1:], strict=False))


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    trained = language_id.train(docs.where(~language_id.in_fold("doc_id", 5)))
    model = language_id.Model(trained.languages, trained.weights.astype(np.float32), trained.moves)
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    known = {}
    for r in rows:
        label, share, switches = labelled(r["text"], model, known)
        mine = got[r["doc_id"]]
        assert mine["lang_pred"] == label and mine["score"] == pytest.approx(share, abs=1e-4)
        assert abs(mine["switches"] - switches) <= 0.001 * len(r["text"] or "")  # words at which two languages tie


def test_ties_and_long_texts(spark):
    """Without weights all languages tie and the first by name is taken; a long text is labelled from its whole."""
    train = spark.createDataFrame([(1, "aa bb cc " * 9, "x"), (2, "dd ee ff " * 9, "y")], "doc_id long, text string, lang string")
    model = language_id.train(train)
    rows = spark.createDataFrame([(1, "aa bb " * 200 + "dd ee ff " * 20_000, "y"), (2, "aa dd", "x"), (2, "aa dd", "x")], "doc_id long, text string, lang_pred string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(rows, model).collect())
    assert got[0][1] == "y" and got[1] == got[2]  # repeated rows alike, a column of that name is left out
    known = {}
    for k in (0, 1):
        label, share, _ = labelled(rows.collect()[k]["text"], model, known)
        assert got[k][1] == label and got[k][2] == pytest.approx(share, abs=1e-4)
    level = language_id.Model(model.languages, np.zeros_like(model.weights), np.zeros_like(model.moves))
    tied = language_id.predict(rows, level).collect()
    assert {(r["lang_pred"], round(r["score"], 9)) for r in tied} == {("x", 0.5)}
