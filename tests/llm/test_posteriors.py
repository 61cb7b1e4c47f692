"""The quality classifier's posteriors and scores against the same sums in plain Python."""

import math
import random
from collections import defaultdict

import pytest

from wrenfold.llm import quality_classifier, queries

SMALL = "/root/testdata/sf0.001"


def strength(groups):
    """groups: (n, mean, centre, variance summed within)."""
    total, k = sum(g[0] for g in groups), len(groups)
    if k < 2 or total <= k:
        return 1.0
    inside = max(sum(g[3] for g in groups) / (total - k), 1e-9)
    spread = sum(n * (m - c) ** 2 for n, m, c, _ in groups)
    between = (spread - (k - 1) * inside) / max(1e-9, total - sum(g[0] ** 2 for g in groups) / total)
    return min(1e6, max(1.0, inside / max(between, 1e-9)))


def odds(p):
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def by_hand(rows, weight=1.0):
    """(host posterior, path posterior, score) of each (host, path, p)."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    mean = lambda xs: sum(xs) / len(xs)
    within = lambda xs: sum((x - mean(xs)) ** 2 for x in xs)
    overall = mean([p for *_, p in rows])
    kh = strength([(len(x), mean(x), overall, within(x)) for x in hosts.values()])
    hp = {h: (sum(x) + kh * overall) / (len(x) + kh) for h, x in hosts.items()}
    kp = strength([(len(x), mean(x), mean(hosts[h]), within(x)) for (h, _), x in paths.items()])
    out = []
    for host, path, p in rows:
        x = paths[host, path]
        others = (sum(x) - p + kp * hp[host]) / (len(x) - 1 + kp)
        z = odds(p) + weight * (odds(others) - odds(overall))
        out.append((hp[host], (sum(x) + kp * hp[host]) / (len(x) + kp), 1 / (1 + math.exp(-z))))
    return out


def same(got, weight=1.0):
    want = by_hand([(r["host"], r["path"], r["evidence"]) for r in got], weight)
    for r, (host, path, score) in zip(got, want, strict=True):
        assert r["host_posterior"] == pytest.approx(host, abs=1e-7) and r["path_posterior"] == pytest.approx(path, abs=1e-7)
        assert r["score"] == pytest.approx(score, abs=1e-7) and r["kept"] == (r["score"] >= 0.5)


@pytest.mark.parametrize("weight", [1.0, 0.5])
def test_random_sites(spark, weight):
    r = random.Random(3)
    rows = []
    for i in range(600):
        # a third of all on one host, names that are null or empty, and sites of one document
        host = r.choice(["hot", None, "", f"h{r.randrange(12)}", f"one{i}"]) if i % 3 else "hot"
        lean = {"hot": 0.2, None: 0.6}.get(host, 0.4)
        rows.append((i if i % 50 else None, host, r.choice([None, "", "p", "q"]), min(1.0, max(0.0, lean + r.gauss(0, 0.15)))))
    rows += rows[:9]  # repeated rows count each
    got = quality_classifier.judge(spark.createDataFrame(rows, "doc_id long, host string, path string, p double").repartition(5), weight).collect()
    assert sorted((str(g["doc_id"]), str(g["host"]), str(g["path"]), g["evidence"]) for g in got) == sorted((str(a), str(b), str(c), d) for a, b, c, d in rows)
    same(got, weight)


def test_one_site(spark):
    same(quality_classifier.judge(spark.createDataFrame([(1, "h", "p", 0.25), (2, "h", "p", 0.75), (3, "h", "p", 1.0)], "doc_id long, host string, path string, p double")).collect())


def test_query(spark):
    got = queries.op3_quality_classifier(spark, SMALL).collect()
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len(got) == n and len({g["doc_id"] for g in got}) == n
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    # the evidence is the model's, a text at a time
    w, b = quality_classifier.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    for g in got:
        z = float(quality_classifier.features(docs[g["doc_id"]]["text"]) @ w) + b
        assert g["evidence"] == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))), abs=1e-6)
    same(got)
