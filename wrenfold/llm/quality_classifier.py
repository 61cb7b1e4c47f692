"""Quality of documents by hierarchical empirical Bayes: what a text shows, and what its site is like.

A logistic regression on a text's form (triples of byte classes, repeated words and lines) gives each document a
probability of being good. The hosts' and paths' mean probabilities are grouped aggregates over all documents. A
host's posterior is its mean shrunk toward the global mean, a path's its mean shrunk toward its host's posterior:
(n * mean + k * prior) / (n + k), with k the strength of the prior, taken from the spread between groups by the
method of moments, so sparse sites move little. The score adds, in log-odds, `weight` times how far the document's
path lies from the global mean, with the document's own part of its path's sum left out.

The regression is fitted on the driver to at most `most` labelled rows, those of the least hash of their ids; all
means cover all documents; of several texts of one id it takes the least. A group is summed in part before the shuffle, and as many rows as groups are shuffled.

Defined cases: a null text is empty, a null host or path a group of its own; a document whose label is null trains
nothing; without both labels the evidence is 0.5 for all; equal scores stay equal; repeated rows count each; an
empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import least_hashes, written

#: Classes of bytes: end of line, blank, small, large, digit, stop, mark, other ASCII, continuation, lead of 2, of more.
_CLASSES = 11
FEATURES = _CLASSES**3 + 6


def _byte_classes() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    table[[9, 11, 12, 13, 32]] = 1
    table[10] = 0
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    table[[ord(c) for c in "#*$%&|<>{}[]=+@_~^/\\"]] = 6
    table[0x80:0xC0], table[0xC0:0xE0], table[0xE0:] = 8, 9, 10
    return table


_TABLE = _byte_classes()


def features(text: str | None) -> np.ndarray:
    """Shares of byte-class triples under a root, shares of repeated words and lines, and lengths, of the whole text."""
    raw = (text or "").encode("utf-8")
    out = np.zeros(FEATURES, np.float32)
    c = _TABLE[np.frombuffer(raw, np.uint8)]
    if len(c) > 2:
        counts = np.bincount(c[:-2] * _CLASSES**2 + c[1:-1] * _CLASSES + c[2:], minlength=_CLASSES**3)
        out[: _CLASSES**3] = np.sqrt(counts / (len(c) - 2))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    if n:
        pairs = list(zip(words, words[1:], strict=False))
        out[-6] = 1 - len(set(words)) / n
        out[-5] = 1 - len(set(pairs)) / max(1, len(pairs))
        out[-4] = sum(a == b for a, b in pairs) / n
        out[-3] = 1 - len(set(lines)) / len(lines)
        out[-2] = np.log10(n)
    out[-1] = n >= 50
    return out


def fit(texts: list[str], good: list[int], steps: int = 400, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch AdaGrad; the classes weigh alike."""
    if len(set(good)) < 2:
        return np.zeros(FEATURES), 0.0
    x = np.stack([features(t) for t in texts]).astype(np.float64)
    y = np.array(good, np.float64)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b, sw, sb = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-8), 1e-8
    for _ in range(steps):
        e = share * (y - 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))) / len(y)
        gw, gb = x.T @ e - decay * w, e.sum()
        sw, sb = sw + gw**2, sb + gb**2
        w, b = w + rate * gw / np.sqrt(sw), b + rate * gb / np.sqrt(sb)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Fits the evidence to the labelled rows of the least hash of their ids, at most `most`."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    h = F.xxhash64(id_col)
    chosen = known.where(least_hashes(h, most, F.lit(known.count()))).orderBy(h, id_col).limit(most)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    # of several texts of one id the least, so that the model does not depend on the order of rows
    sample = rows.groupBy(id_col).agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()  # `most` rows at most
    sample.sort(key=lambda r: r[id_col])
    return fit([r["text"] for r in sample], [int(r["y"] > 0) for r in sample])


def evidence(docs: DataFrame, model: tuple[np.ndarray, float], host_col: str, path_col: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, host, path, p), p the probability by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            z = np.array([float(features(t.as_py()) @ w) + b for t in batch.column(3)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], ["doc_id", "host", "path", "p"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, p double")


def _strength(groups: DataFrame, n: str, mean: str, centre: str, within: str) -> float:
    """How many documents a prior counts for: variance within groups over that between them, by moments."""
    weight = F.sum(n).alias("total")
    row = groups.agg(
        weight,
        F.sum(F.col(n) * (F.col(mean) - F.col(centre)) ** 2).alias("spread"),
        F.sum(F.col(within)).alias("inside"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col(n) * F.col(n)).alias("squares"),
    ).first()
    total, k = row["total"] or 0, row["groups"]
    if k < 2 or total <= k:
        return 1.0
    inside = max(row["inside"] / (total - k), 1e-9)
    between = (row["spread"] - (k - 1) * inside) / max(1e-9, total - row["squares"] / total)
    return float(min(1e6, max(1.0, inside / max(between, 1e-9))))


def judge(found: DataFrame, weight: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """evidence() rows with host_posterior, path_posterior, score and kept: score >= threshold."""
    spark_rows = written(found, "evidence")
    paths = written(spark_rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = total[1] / total[0] if total[0] else 0.5
    hosts = written(hosts.withColumns({"hmean": F.col("hs") / F.col("hn"), "centre": F.lit(float(mean)), "within": F.greatest(F.lit(0.0), F.col("hss") - F.col("hs") * F.col("hs") / F.col("hn"))}), "hosts")
    k_host = _strength(hosts, "hn", "hmean", "centre", "within")
    hosts = hosts.select("host", "hn", "hs", "hmean", ((F.col("hs") + k_host * mean) / (F.col("hn") + k_host)).alias("host_posterior"))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(
        paths["host"], "path", "n", "s", "host_posterior", "hmean", (F.col("s") / F.col("n")).alias("pmean"),
        F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
    )
    k_path = _strength(both, "n", "pmean", "hmean", "within")
    sites = both.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_posterior", ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior"))

    def odds(p):
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(p / (1 - p))

    others = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    z = odds(F.col("p")) + weight * (odds(others) - float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))))
    rows = spark_rows.join(sites, spark_rows["host"].eqNullSafe(sites["h"]) & spark_rows["path"].eqNullSafe(sites["q"]))
    return rows.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("score")).withColumn("kept", F.col("score") >= threshold)
