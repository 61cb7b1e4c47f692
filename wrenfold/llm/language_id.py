"""Language identification of words in code-switched text by a linear-chain conditional random field.

Every word gets one of the learned languages. A word's features are hashed: its affixes and character n-grams
(2 to 4 bytes, with marks at both ends, so that an n-gram with a mark is an affix) and the word itself (the
lexicon). The weights of its features give a score for each language, and learned transitions join neighbouring
words; forward-backward gives each word's posterior. A document's language is that with the most expected words,
its score the share of these.

Training takes at most `per_language` documents of each language, those with the least hash of their ids and texts, so
the sample has a bound and does not depend on the order of rows. As documents have one label each, runs of words of
different languages are joined into code-switched sequences; from these the transitions are learned. The weights
are fitted on the driver with numpy and go to the tasks as one array of fixed size.

Prediction reads whole texts. All texts of a batch advance together, a step a word, those that have ended leave.

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled rows every text with
a letter is `und`; ties go to the language first in order; rows whose language is null train nothing; repeated
rows each get their row; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wrenfold.llm.common import least_hashes, written
from wrenfold.llm.tokens import groups

#: Rows of the weight table: features are hashed to these.
BUCKETS = 1 << 17
#: Words of a training sequence, and longest run of one language in it, on average.
STEPS, RUN = 48, 16
#: Words after which the texts read so far are labelled.
GROUP = 1_000_000
#: Words whose features are held at a time, some 2000 bytes each.
SCORED = 1 << 15
#: Batches of an epoch, at most.
BATCHES = 250
#: Marks before and after a word, bytes that UTF-8 text has only as controls.
BEFORE, AFTER = 2, 3


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words one after another, and where each word's begin."""
    buffer = np.frombuffer(b"".join([b"\x02%b\x03" % w for w in words]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(buffer))  # bytes from here to the word's end
    code = buffer.astype(np.uint64)
    found, owner = [], []
    place = np.repeat(np.arange(len(words)), sizes)
    hashed = code + np.uint64(1)
    for n in (2, 3, 4):
        nxt = np.zeros(len(code), np.uint64)
        nxt[: len(code) - n + 1] = code[n - 1 :]
        hashed = hashed * np.uint64(0x100000001B3) + nxt
        ok = left >= n
        found.append(hashed[ok] * np.uint64(2 * n + 1))
        owner.append(place[ok])
    whole = np.add.reduceat((code + np.uint64(7)) * _powers(np.arange(len(buffer)) - np.repeat(ends - sizes, sizes)), ends - sizes) if len(words) else code
    found.append(whole * np.uint64(0x9E3779B97F4A7C15))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    rows = ((np.concatenate(found) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 17)).astype(np.int64)[order]
    counts = np.bincount(owner, minlength=len(words))
    return rows, np.cumsum(counts) - counts


def _powers(k: np.ndarray) -> np.ndarray:
    table = np.cumprod(np.full(256, 0x100000001B3, np.uint64), dtype=np.uint64)
    return table[k % 256] + (k // 256).astype(np.uint64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    moves: np.ndarray  # (languages, languages), log-potentials from row to column

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of the words, whose features are held for SCORED of them at a time."""
        out = [np.empty((0, len(self.languages)))]
        for at in range(0, len(words), SCORED):
            rows, starts = word_features(words[at : at + SCORED])
            sizes = np.diff(np.append(starts, len(rows)))
            out.append(np.add.reduceat(self.weights[rows], starts, axis=0) / np.sqrt(sizes)[:, None])
        return np.concatenate(out)


def posteriors(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward over several sequences: scores of their words one after another, and where each begins."""
    n, k = scores.shape
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[order], sizes[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    m = np.exp(moves - moves.max())
    ahead = np.empty((n, k))
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # sequences longer than each step
    for t in range(steps):
        at = first[: alive[t]] + t
        a = e[at] if t == 0 else (a[: alive[t]] @ m) * e[at]
        a = a / a.sum(axis=1, keepdims=True)
        ahead[at] = a
    b = np.empty((0, k))
    for t in range(steps - 1, -1, -1):
        at = first[: alive[t]] + t
        behind = np.ones((alive[t], k))
        if len(b):
            behind[: len(b)] = b @ m.T
            behind[: len(b)] /= behind[: len(b)].sum(axis=1, keepdims=True)
        joint = ahead[at] * behind
        ahead[at] = joint / joint.sum(axis=1, keepdims=True)
        b = behind * e[at]
    return ahead


def fit(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient ascent (AdaGrad) on the likelihood of code-switched sequences of the texts' words."""
    languages = sorted(set(labels))
    k = len(languages)
    model = Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    pools = [[w for t, y in zip(texts, labels, strict=True) if y == lang for w in split(t)] for lang in languages]
    pools = [p or [b""] for p in pools]
    step_w, step_m = np.full((BUCKETS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    batch = 64
    # each language is drawn equally often; an epoch has as many words as the largest pool, within a bound
    batches = max(20, min(BATCHES, max(map(len, pools)) // (batch * STEPS)))
    for _ in range(epochs * batches):
        y = np.empty((batch, STEPS), np.int64)
        y[:, 0] = rng.integers(0, k, batch)
        for t in range(1, STEPS):
            y[:, t] = np.where(rng.random(batch) < 1 / RUN, rng.integers(0, k, batch), y[:, t - 1])
        at = [rng.integers(0, len(p)) for p in pools]
        words = []
        for c in y.ravel():
            words.append(pools[c][at[c] % len(pools[c])])
            at[c] += 1
        rows, begins = word_features(words)
        sizes = np.diff(np.append(begins, len(rows)))
        scale = (1 / np.sqrt(sizes)).astype(np.float32)
        scores = np.add.reduceat(model.weights[rows], begins, axis=0) * scale[:, None]
        m = np.exp(model.moves - model.moves.max())
        e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(batch, STEPS, k).astype(np.float64)
        a, b = np.empty_like(e), np.ones_like(e)
        for t in range(STEPS):
            a[:, t] = e[:, t] if t == 0 else (a[:, t - 1] @ m) * e[:, t]
            a[:, t] /= a[:, t].sum(axis=1, keepdims=True)
        for t in range(STEPS - 2, -1, -1):
            b[:, t] = (b[:, t + 1] * e[:, t + 1]) @ m.T
            b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
        p = a * b
        p /= p.sum(axis=2, keepdims=True)
        pair = a[:, :-1, :, None] * m * (b[:, 1:] * e[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1], y[:, 1:]), 1)
        g_m = (seen - pair.sum(axis=(0, 1))) / batch
        g = (np.eye(k)[y] - p).reshape(-1, k).astype(np.float32) * scale[:, None]
        unique, inverse = np.unique(rows, return_inverse=True)
        g_w = np.zeros((len(unique), k), np.float32)
        per = np.repeat(g, sizes, axis=0)
        for c in range(k):
            g_w[:, c] = np.bincount(inverse, per[:, c], len(unique))
        step_w[unique] += g_w**2
        model.weights[unique] += rate * g_w / np.sqrt(step_w[unique])
        step_m += g_m**2
        model.moves += 0.1 * g_m / np.sqrt(step_m)
    return model


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").split()


def in_fold(id_col: str, folds: int) -> Column:
    """Whether crc32 of the id as text is divisible by folds; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, per_language: int = 400, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(text, lang), at most per_language rows a language: those of the least hash of id and text, then of the text.

    Rows are narrowed by their hash in the scanning tasks. Of a language for which fewer than are wanted pass, as
    where thousands of rows repeat one, all rows go to the exact choice.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total")), "language-sizes")
    order = Window.partitionBy("lang").orderBy("h", "text")

    def least(few: DataFrame) -> DataFrame:
        return few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("text", "lang")

    def joined(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if some.count() <= 10_000 else some, "lang")

    found = written(least(joined(sizes).where(least_hashes(F.col("h"), per_language, F.col("total")))), "language-sample")
    got = found.groupBy("lang").agg(F.count(F.lit(1)).alias("got"))
    short = written(sizes.join(got, "lang", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.col("total"), F.lit(per_language))).select("lang"), "short-languages")
    if short.isEmpty():
        return found
    return found.join(short, "lang", "left_anti").select("text", "lang").unionByName(least(joined(short)))


def train(docs: DataFrame, per_language: int = 400, most_rows: int = 100_000, **columns: str) -> Model:
    """Fits the model to the bounded sample of training_rows(); docs holds no row that must not be learned from.

    The sample has most_rows rows at most: with more languages than most_rows / per_language, fewer of each.
    """
    languages = docs.where(F.col(columns.get("lang_col", "lang")).isNotNull()).agg(F.countDistinct(columns.get("lang_col", "lang"))).first()[0] if per_language > 1 else 1
    sample = training_rows(docs, max(1, min(per_language, most_rows // max(1, languages))), **columns).collect()
    sample.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, switches): switches counts neighbouring words of different likeliest languages.

    The id may be of any type, a struct of all columns too.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, moves = shared.value
        m = Model(languages, weights, moves)
        for batch in batches:
            at = 0
            for part in groups(batch.column(1)):  # texts of a few MB advance together
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *_predict(m, part.to_pylist())], ["doc_id", "lang_pred", "score", "switches"])
                at += len(part)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = StructType.fromDDL("lang_pred string, score double, switches long")
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *found.fields]))


def _predict(model: Model, texts: list[str | None]) -> list[pa.Array]:
    n, k = len(texts), len(model.languages)
    pred, score, switches = ["und"] * n, [0.0] * n, [0] * n
    with_letters = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if k else []
    group: list[int] = []
    held: list[list[bytes]] = []
    size = 0
    for i in [*with_letters, -1]:
        if i >= 0:
            group.append(i)
            held.append(split(texts[i]))
            size += len(held[-1])
        if group and (i < 0 or size >= GROUP):
            places: dict[bytes, int] = {}
            place = places.setdefault
            at = np.array([place(w, len(places)) for ws in held for w in ws], np.int64)
            scores = model.emissions(list(places))[at]
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            starts = np.cumsum(sizes) - sizes
            p = posteriors(scores, starts, model.moves)
            share = np.add.reduceat(p, starts, axis=0) / sizes[:, None]
            best = p.argmax(axis=1)
            turns = np.append(best[1:] != best[:-1], False)
            turns[starts + sizes - 1] = False
            turns = np.add.reduceat(turns.astype(np.int64), starts)
            for j, doc in enumerate(group):
                c = int(share[j].argmax())
                pred[doc], score[doc], switches[doc] = model.languages[c], min(1.0, float(share[j, c])), int(turns[j])
            group, held, size = [], [], 0
    return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())]
