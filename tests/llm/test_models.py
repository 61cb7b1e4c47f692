"""The trained models: probabilities that sum to one, held-out figures, brute-force counts, edge cases."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wrenfold.llm import language_id, lm, nearest, quality_classifier, queries

LARGER = "/root/testdata/sf0.01"


def crc(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    want = np.zeros((8, 3))
    for a, b in ((0, 4), (4, 5), (5, 8)):
        acc, total = np.zeros((b - a, 3)), 0.0
        for y in itertools.product(range(3), repeat=b - a):
            w = math.exp(sum(scores[a + i, c] for i, c in enumerate(y)) + sum(moves[u, v] for u, v in itertools.pairwise(y)))
            total += w
            for i, c in enumerate(y):
                acc[i, c] += w
        want[a:b] = acc / total
    assert np.abs(want - language_id.posteriors(scores, np.array([0, 4, 5]), moves)).max() < 1e-12


def test_language_held_out(spark):
    got = queries.op4_language_id(spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "aa bb cc " * 9, "x"), (2, "dd ee ff " * 9, "y"), (3, None, "x"), (4, "zz", None), (5, "", "y")], "doc_id long, text string, lang string")
    model = language_id.train(train)
    assert model.languages == ["x", "y"]
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "aa bb"), (5, "dd ee ff aa bb cc"), (5, "ee ff")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(rows, model).collect()]
    assert got[:4] == [(1, "und"), (2, "und"), (3, "und"), (None, "x")] and got[5] == (5, "y")
    nothing = language_id.train(train.limit(0))
    assert [r["lang_pred"] for r in language_id.predict(rows, nothing).collect()] == ["und"] * 6
    assert language_id.predict(rows.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op7_lm_scoring(spark, LARGER).collect()


def test_lm_counts_and_gain(spark, scored):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    c = Counter()
    for i, t in docs.items():
        if crc(i, 10):
            c.update(lm.words_of(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    assert len(scored) == len(docs)
    for r in scored:
        words = [*lm.words_of(docs[r["doc_id"]]), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want)
    held = [r for r in scored if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / tokens > sum(r["base_score"] for r in held) / tokens + 0.1


def test_lm_is_a_distribution(spark, monkeypatch):
    """Over the words of a tiny vocabulary, and unseen ones, probabilities after each context sum to one."""
    monkeypatch.setattr(lm, "HEAD", 3)
    monkeypatch.setattr(lm, "WORDS", 2)
    docs = spark.createDataFrame([(i, "a b a c d e a b") for i in range(5)], "doc_id long, text string")
    model, counts = lm.train(docs)
    model.ready()
    n = model.classes
    contexts = np.array([(0, 0), (0, 1), (1, 2), (2, 1), (5, n - 1)])
    p = lambda far, near, t: 10.0 ** float(model.log_probabilities(np.array([far]), np.array([near]), np.array([t]))[0])
    for far, near in contexts:
        assert abs(sum(10.0 ** model.log_probabilities(np.full(n, far), np.full(n, near), np.arange(n))) - 1) < 1e-5
    of_bucket = model.bucket_counts
    assert of_bucket[:, 0].sum() == 5 * 3 and of_bucket[:, 1].sum() == 3  # c, d, e
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame([(0, ""), (1, "c"), (2, "a"), (3, "zz"), (4, "a c b")], "doc_id long, text string"), model, counts).collect()}
    places, of = model.lookup()
    a, b = of[places["a"]], of[places["b"]]
    k = 1 + model.n_words + lm.bucket(b"c")
    total, v = of_bucket[lm.bucket(b"c")]
    share = (5 + 0.1) / (total + 0.1 * (v + 1))
    want = {0: p(0, 0, 0), 1: p(0, 0, k) * share * p(0, k, 0), 2: p(0, 0, a) * p(0, a, 0), 4: p(0, 0, a) * p(0, a, k) * share * p(a, k, b) * p(k, b, 0)}
    for i, x in want.items():
        assert abs(got[i] - math.log10(x)) < 1e-5


@pytest.mark.parametrize("head", [50, 3])
def test_lm_of_many_equal_counts(spark, monkeypatch, head):
    """More words of one count than the head takes: the first in order have classes, and counts stay exact."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "WORDS", 20)
    docs = spark.createDataFrame([(i, " ".join(f"w{k:03d}" for k in range(200))) for i in range(3)], "doc_id long, text string")
    model, counts = lm.train(docs)
    assert [w for w, _ in model.head] == [f"w{k:03d}" for k in range(head)] and model.n_words == min(20, head)
    r = lm.score(docs, model, counts).first()
    assert r["n_known"] == 201 and abs(r["base_score"] - 201 * math.log10(3.1 / (603 + 0.1 * 202))) < 1e-9


def test_lm_query_by_brute_force(spark):
    """The query's scores from the model's weights, token by token, on the smallest tables."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model, counts = lm.train(docs.where(~language_id.in_fold("doc_id", 10)))
    c = dict((r["word"], r["n"]) for r in counts.collect())
    w = model.weights
    places, of = model.lookup()
    got = {r["doc_id"]: r["score"] for r in queries.op7_lm_scoring(spark, SMALL).collect()}
    for d in docs.orderBy("doc_id").collect()[:40]:
        words = [x.decode() for x in lm.words_of(d["text"])]
        classes = [of[places[x]] if x in places else 1 + model.n_words + lm.bucket(x.encode()) for x in words] + [0]
        total, near, far = 0.0, 0, 0
        for x, t in zip([*words, ""], classes, strict=True):
            logits = (w["r"][near] @ w["near"] + w["r"][far] @ w["far"]) @ w["s"].T + w["b"]
            total += (logits[t] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if t > model.n_words:
                n, v = model.bucket_counts[t - 1 - model.n_words]
                total += math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1)))
            far, near = near, t
        assert abs(got[d["doc_id"]] - total) < 1e-4 * abs(total)


def test_lm_gains_on_a_class_bigram(spark, scored):
    """Held-out gain over the smoothed bigram of the same classes, weighed with the class unigram."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    model, counts = lm.train(spark.read.parquet(f"{LARGER}/documents.parquet").where(~language_id.in_fold("doc_id", 10)))
    c = dict((r["word"], r["n"]) for r in counts.collect())
    places, of = model.lookup()
    cls = lambda x: of[places[x]] if x in places else 1 + model.n_words + lm.bucket(x.encode())
    n = model.classes
    pairs = np.zeros((n, n))
    rows = {i: [cls(x.decode()) for x in lm.words_of(t)] + [0] for i, t in docs.items()}
    for i, row in rows.items():
        if crc(i, 10):
            np.add.at(pairs, ([0, *row[:-1]], row), 1)
    unigram = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * n)
    pairs = np.log10((pairs + 20 * unigram) / (pairs.sum(axis=1, keepdims=True) + 20))
    held = [r for r in scored if r["held_out"]]
    bigram = 0.0
    for r in held:
        row, words = rows[r["doc_id"]], [x.decode() for x in lm.words_of(docs[r["doc_id"]])]
        bigram += pairs[[0, *row[:-1]], row].sum()
        for x, t in zip(words, row, strict=False):
            if t > model.n_words:
                m, v = model.bucket_counts[t - 1 - model.n_words]
                bigram += math.log10((c.get(x, 0) + 0.1) / (m + 0.1 * (v + 1)))
    tokens = sum(r["n_tokens"] for r in held)
    print("log10 a token: model", sum(r["score"] for r in held) / tokens, "bigram", bigram / tokens, "base", sum(r["base_score"] for r in held) / tokens)
    assert sum(r["score"] for r in held) > bigram


def test_lm_edges(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x y"), (3, "")], "doc_id long, text string")
    model, counts = lm.train(rows.limit(0))
    got = lm.score(rows, model, counts).collect()
    assert len(got) == 4 and all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in got)
    assert lm.score(rows.limit(0), model, counts).count() == 0


def test_quality_classifier(spark):
    rows = queries.op3_quality_classifier(spark, LARGER)
    truth = spark.read.parquet(f"{LARGER}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"))
    got = rows.join(truth, "doc_id").collect()
    assert rows.count() == 1000
    good = [r["kept"] for r in got if r["q"] == 1]
    bad = [r["kept"] for r in got if r["q"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_posteriors_by_hand(spark):
    found = spark.createDataFrame([(i, "h" if i < 40 else "g", "p" if i % 2 else None, 0.9 if i < 40 else 0.1) for i in range(44)] + [(None, None, None, 0.5)], "doc_id long, host string, path string, p double")
    got = {r["doc_id"]: r for r in quality_classifier.judge(found).collect()}
    assert len(got) == 45
    mean = (40 * 0.9 + 4 * 0.1 + 0.5) / 45
    assert 0.9 > got[0]["host_posterior"] > mean > got[41]["host_posterior"] > 0.1
    assert got[0]["score"] > got[0]["evidence"] and got[41]["score"] < got[41]["evidence"]
    # the sparse site moves less
    assert abs(got[None]["host_posterior"] - mean) < abs(0.5 - mean)
    assert quality_classifier.judge(found.limit(0)).count() == 0


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "h", "p"), (3, "a b c", "h", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.judge(quality_classifier.evidence(docs, model, "source", "lang")).collect()
    assert len(got) == 4 and all(r["evidence"] == 0.5 for r in got)


def brute_nearest(rows, asks, k):
    """Lists of (id, score), nearest first, of every row that asks, by its id."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for n, (i, v) in enumerate(usable):
        if asks(i):
            s = []
            for m, (j, w) in enumerate(usable):
                if m != n and len(w) == len(v):
                    score = 0.0
                    for a, b in zip(v.tolist(), w.tolist(), strict=True):
                        score += a * b
                    s.append((math.inf if score != score else -score, j, score))
            out.setdefault(i, []).append([(j, x) for _, j, x in sorted(s, key=lambda e: e[:2])[:k]])
    return out


def found_nearest(df, asks, k):
    """The same of nearest(); rows of one id are told apart by their order of ranks."""
    lists = {}
    for r in nearest.nearest(df, asks, k).collect():
        lists.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return lists


@pytest.mark.parametrize(("q_block", "block"), [(8192, 16384), (4, 16)])
def test_nearest(spark, monkeypatch, q_block, block):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", q_block)
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(150)]
    rows[7] = (7, None)
    rows[10] = (10, [0.0] * 8)
    rows[20] = (20, [*rows[20][1][:7], float("nan")])
    rows[30] = (30, [*rows[30][1][:7], None])
    rows[33] = (33, rows[34][1])  # a tie
    rows[40] = (40, rows[50][1])
    rows += [(None, rows[1][1]), (200, [1.0, 2.0]), (210, [1.0, 3.0]), (205, [float("inf"), 1.0]), (220, [1e-30] * 8), (230, [1e15] * 8)]
    rows += [(60, rows[61][1]), (60, rows[61][1]), (70, rows[3][1])]  # repeated ids
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, score int")
    want = brute_nearest(rows, lambda i: i % 10 == 0, 5)
    got = found_nearest(df, F.col("vec_id") % 10 == 0, 5)
    assert got.keys() == want.keys()
    for i, lists in want.items():
        for rank, found in got[i].items():
            assert sorted(found) == sorted(x[rank - 1] for x in lists if len(x) >= rank)
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_nearest_of_any_magnitudes(spark, seed):
    """Components from the least to the greatest double, in one vector and across them; nothing may be lost."""
    rng = np.random.default_rng(seed)
    rows = [(0, [1e200, 0.0]), (65, [0.0, 1e200]), (1, [1.0, 2.0]), (2, [3.0, 1.0])] if not seed else []
    for i in range(3, 60):
        power = rng.choice([-320, -300, -160, -1, 0, 1, 150, 200, 307], 2) if seed % 2 else np.full(2, rng.choice([-320, -160, 0, 160, 300]))
        rows.append((i, [float(x * 10.0**p) for x, p in zip(rng.normal(size=2), power, strict=True)]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, lambda i: i % 5 == 0, 7)
    got = found_nearest(df, F.col("vec_id") % 5 == 0, 7)
    assert got.keys() == want.keys()
    for i, (found,) in want.items():
        assert repr([got[i][r][0] for r in range(1, len(found) + 1)]) == repr(found) and len(got[i]) == len(found)
