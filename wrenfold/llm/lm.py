"""Scoring of texts by a log-bilinear neural language model trained with noise-contrastive estimation.

The model predicts each token's class from the two tokens before it: with vectors r of contexts and s of targets, a
matrix for each position of the context and biases b, the score of target w after h2 h1 is
(r_h1 C1 + r_h2 C2) . s_w + b_w, and a softmax over all classes makes it a probability. Classes are the most frequent
words, the end of a text, and buckets that all other words share by their last two letters; in a bucket, a word has
the smoothed share of its count, and all words never seen have one share together. So the probabilities of all
texts sum to one.

Passes over the texts on Spark: word counts of all training texts; their classes, written once as two bytes a token
(`coded`); the fit; and the scores. The fit goes through every place of every text: in each of ROUNDS rounds, tasks
take their part of the places in batches of runs against noise drawn from the unigram distribution of all tokens, each from
the same weights, and the means of what they end with, by their numbers of places, are the next round's weights. So
tasks grow with the tokens, and no triple passes through the driver. A task has STEPS batches, so few tokens are one
task's, which goes through them again and again. The number of words with a class and the batches of a task grow with
the fifth root of the number of tokens (GROWTH). A context's normaliser is a sum over classes of a factor of its far
token times a factor of its near one, so one matrix product gives those of all contexts; a worker makes it once. Counts of the
most frequent words, HEAD at most, go to the tasks with them. The other words of a text are joined to the whole
table of counts by a shuffle, so no vocabulary needs to fit anywhere.

Defined cases: a null or empty text is the end token alone; a null id is held out; repeated rows are scored each;
words of equal counts go by the word itself, in the choice of classes and of the head; without training texts every
count is zero and all classes are alike; texts of any length are read whole; an empty table gives an empty result;
other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import removed, written
from wrenfold.llm.tokens import groups, split_words

#: Words with a class of their own, and batches that a task of the fit takes, both for BASE tokens; from there they grow by this power.
WORDS, STEPS = 1000, 1200
BASE, GROWTH = 10_000_000, 0.2
#: Places of a run, runs of a batch, its draws of noise, rounds of more than one task, and parts of the weights that meet in a task.
RUN, RUNS, NOISE, ROUNDS, PARTS = 16, 128, 128, 5, 64
#: Tokens of a row of coded texts at most, and the bit of a code that only gives context.
PIECE, CONTEXT = 1 << 16, 1 << 15
#: Buckets of the other words, and width of the vectors.
BUCKETS, WIDTH = 280, 32
#: Most words whose counts go to every task.
HEAD = 200_000
#: Contexts whose scores of all classes are held at once, and the least sum of factors that counts: 32 bits lose nothing that matters in more.
ROWS, LEAST_SUM = 128, 1e-25
#: Bytes of texts that are counted, and scored, together, about.
COUNTED_BYTES, SCORED_BYTES = 1 << 24, 1 << 22
#: The end of a text, in the table of counts; no word is empty.
END = ""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and the six ASCII blanks count


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same of all texts one after another, and where each text's end."""
    return split_words(pc.ascii_lower(pc.fill_null(texts, "")))


def grown(tokens: int) -> float:
    return max(1.0, tokens / BASE) ** GROWTH


def bucket(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8")[-2:].encode("utf-8")) % BUCKETS


def bucket_col(word: Column) -> Column:
    """The same of a column."""
    return (F.crc32(F.substring(word, -2, 2).cast("binary")) % BUCKETS).cast("int")


@dataclass
class Model:
    """All that a task needs. Classes: first the end, then words, then buckets."""

    tokens: int  # N and V of the training texts
    distinct: int
    head: list[tuple[str, int]]  # most frequent first; the first n_words have classes
    n_words: int
    end_count: int
    bucket_counts: np.ndarray  # N and V of each bucket's words
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return 1 + self.n_words + BUCKETS

    def class_counts(self) -> np.ndarray:
        return np.concatenate([[self.end_count], [n for _, n in self.head[: self.n_words]], self.bucket_counts[:, 0]]).astype(np.float64)

    def context(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The vectors that contexts predict with, of the classes two tokens and one token before."""
        return self.weights["by_near"][near] + self.weights["by_far"][far]

    def ready(self) -> None:
        """Makes the weights ready for scoring, once: each class's vector times each position's matrix, and the contexts' normalisers."""
        w = self.weights
        if "totals" not in w:
            w |= {"by_near": (w["r"] @ w["near"]).astype(np.float32), "by_far": (w["r"] @ w["far"]).astype(np.float32), "s": w["s"].astype(np.float32), "b": w["b"].astype(np.float32)}
            w["totals"] = self._totals()

    def _totals(self) -> np.ndarray:
        """The logs of the sums over classes, a row for each far token, a column for each near one: e^(far + near) is e^far e^near."""
        w, n = self.weights, self.classes

        def factors(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            return np.exp(scores, out=scores), top

        near, near_top = factors(w["by_near"] @ w["s"].T + w["b"])
        totals = np.empty((n, n), np.float32)
        for at in range(0, n, ROWS):
            far, far_top = factors(w["by_far"][at : at + ROWS] @ w["s"].T)
            sums = far @ near.T
            faint = np.argwhere(sums < LEAST_SUM)  # the far token's likely classes are not the near one's
            np.log(np.maximum(sums, LEAST_SUM, out=sums), out=totals[at : at + ROWS])
            totals[at : at + ROWS] += far_top + near_top.T
            for k in range(0, len(faint), ROWS):
                rows, columns = faint[k : k + ROWS].T
                each, top = factors(self.context(at + rows, columns) @ w["s"].T + w["b"])
                totals[at + rows, columns] = np.log(each.sum(axis=1)) + top[:, 0]
        return totals

    def log_probabilities(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the targets' probabilities among all classes after their contexts."""
        self.ready()
        w = self.weights
        out = np.empty(len(target))
        for at in range(0, len(out), 1 << 14):
            f, h, t = (x[at : at + (1 << 14)] for x in (far, near, target))
            out[at : at + (1 << 14)] = np.einsum("ij,ij->i", self.context(f, h), w["s"][t]) + w["b"][t] - w["totals"][f, h]
        out /= np.log(10)
        return out

    def lookup(self) -> tuple[dict[str, int], np.ndarray]:
        """Places of the head's words, and the class of each."""
        places = {w: k for k, (w, _) in enumerate(self.head)}
        of = np.arange(1, len(self.head) + 1)
        of[self.n_words :] = self._buckets(pa.array([w for w, _ in self.head[self.n_words :]], pa.string()))
        return places, of

    def _buckets(self, words: pa.Array) -> np.ndarray:
        """The words' classes if they have none of their own: a bucket for each different end."""
        ends = pc.utf8_slice_codeunits(words, -2, None).dictionary_encode()
        return np.array([1 + self.n_words + bucket(x.encode("utf-8")) for x in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]

    def classes_of(self, words: pa.Array, head: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' classes, and their places in the head, -1 where they aren't."""
        at = pc.fill_null(pc.index_in(words, head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.flatnonzero(at < 0)
        found = of[at] if len(of) else np.zeros(len(at), np.int64)
        found[out] = self._buckets(words.take(pa.array(out)))
        return found, at


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all texts, END with the number of texts. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch.column(0), COUNTED_BYTES):
                words, ends = words_in(part)
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(ends)], pa.int64())], ["word", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The `most` words of the greatest counts, of equal ones the first in order."""
    steps = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(steps.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows
    total, least = 0, 0
    for row in sizes:
        total, least = total + row["count"], row["step"]
        if total >= most:
            break
    # rows below the last step that is needed are left out before the sort
    return counts.where(steps >= least).orderBy(F.desc("n"), "word").limit(most)


def stream(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For words with an end after each text: the word at each place, -1 for ends, and where each text starts."""
    at = np.full(n + len(ends), -1, np.int64)
    closing = ends + np.arange(len(ends))
    own = np.ones(len(at), bool)
    own[closing] = False
    at[own] = np.arange(n)
    return at, np.append(0, closing[:-1] + 1)


def coded(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(slot, classes): texts as 16-bit classes, each with its end, in pieces of at most PIECE. Slots are dealt in turn.

    A piece that goes on with a text has the two classes before it in front, and one that a text goes on behind an
    end after it, all three marked with CONTEXT.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        places, of = m.lookup()
        head = pa.array(list(places), pa.string())
        done = TaskContext.get().partitionId()
        for batch in batches:
            for part in groups(batch.column(0), SCORED_BYTES):
                words, ends = words_in(part)
                words = words.dictionary_encode()
                at, starts = stream(ends, len(words))
                found = np.zeros(len(at), np.uint16)
                own = at >= 0
                found[own] = m.classes_of(words.dictionary, head, of)[0][words.indices.to_numpy()]
                rows = [x for text in np.split(found, starts[1:]) for x in _pieces(text)]
                slots = pa.array(((done + np.arange(len(rows))) % ROUNDS).astype(np.int32))
                done += len(rows)
                yield pa.RecordBatch.from_arrays([slots, pa.array([x.tobytes() for x in rows], pa.binary())], ["slot", "classes"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "slot int, classes binary")


def _pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(text), PIECE):
        before = text[max(0, at - 2) : at] | np.uint16(CONTEXT)
        after = [CONTEXT] if at + PIECE < len(text) else []
        yield np.concatenate([before, text[at : at + PIECE], np.array(after, np.uint16)])


class State:
    """Weights and Adam's two means, each one run of numbers, by name in `w`, `first` and `second`."""

    def __init__(self, classes: int, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        shapes = {"r": (classes, WIDTH), "near": (WIDTH, WIDTH), "far": (WIDTH, WIDTH), "s": (classes, WIDTH), "b": (classes,)}
        ends = np.cumsum([int(np.prod(x)) for x in shapes.values()])
        self.w, self.first, self.second = (
            {k: part[end - int(np.prod(x)) : end].reshape(x) for (k, x), end in zip(shapes.items(), ends, strict=True)} for part in self.flat.reshape(3, -1)
        )

    @classmethod
    def begun(cls, counts: np.ndarray, seed: int = 11) -> State:
        rng = np.random.default_rng(seed)
        n = len(counts)
        w = [rng.normal(0, 0.3, (n, WIDTH)), np.eye(WIDTH), 0.3 * np.eye(WIDTH), rng.normal(0, 0.1, (n, WIDTH)), np.log(_unigram(counts))]
        w = np.concatenate([x.ravel() for x in w])
        return cls(n, np.concatenate([w, np.zeros(2 * len(w))]))


def _unigram(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts + 0.5).sum()


def fit(state: State, codes: np.ndarray, counts: np.ndarray, steps: int, begun: float = 0.0, ended: float = 1.0, before: int = 0, seed: int = 0) -> None:
    """Noise-contrastive estimation on the places of coded texts, with Adam, from `begun` to `ended` of the whole fit.

    Runs of places are taken in random order, all before any is taken again. A batch shares its noise, drawn by counts.
    """
    rng = np.random.default_rng(seed)
    unigram = _unigram(counts)
    q, classes = np.cumsum(unigram), len(counts)
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    n_runs = -(-len(codes) // RUN)
    padded = np.full(n_runs * RUN + 2, CONTEXT, np.uint16)
    padded[2 : 2 + len(codes)] = codes
    runs = np.lib.stride_tricks.sliding_window_view(padded, RUN + 2)[::RUN]
    w = state.w
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order) or (len(order) < RUNS and step < steps):
            order = np.concatenate([order, *[rng.permutation(n_runs) for _ in range(-(-RUNS // n_runs))]])
        taken, order = runs[order[:RUNS]], order[RUNS:]
        own = (taken[:, 2:] < CONTEXT).astype(np.float32)
        taken = (taken & np.uint16(CONTEXT - 1)).astype(np.int64)
        near, t = taken[:, 1:-1].ravel(), taken[:, 2:].ravel()
        first_place = near == 0  # what is before an end belongs to another text
        far = np.where(first_place, 0, taken[:, :-2].ravel())
        z = np.minimum(np.searchsorted(q, rng.random(NOISE)), classes - 1)
        x = (w["r"] @ w["near"])[near] + (w["r"] @ w["far"])[far]
        s_t = w["s"][t]
        g_t = 1 - _sigmoid(np.einsum("ij,ij->i", x, s_t) + w["b"][t] - log_noise[t])
        g_t *= own.ravel()
        g_z = _sigmoid(x @ w["s"][z].T + (w["b"][z] - log_noise[z]))
        g_z *= -own.ravel()[:, None]
        g_x = g_t[:, None] * s_t
        g_x += g_z @ w["s"][z]
        # each class's sums: of what it predicted as the near and the far token, and of its own contexts
        each = np.zeros((*taken.shape, 3 * WIDTH), np.float32)
        wide = g_x.reshape(-1, RUN, WIDTH)
        each[:, 1:-1, :WIDTH] = wide
        each[:, :-2, WIDTH : 2 * WIDTH] = wide * ~first_place.reshape(-1, RUN, 1)
        each[:, 2:, 2 * WIDTH :] = (g_t[:, None] * x).reshape(wide.shape)
        sums = _by_row(taken.ravel(), each.reshape(-1, 3 * WIDTH), classes)
        g_near, g_far, g_s = (sums[:, k * WIDTH : (k + 1) * WIDTH] for k in range(3))
        g_far[0] += g_x[first_place].sum(axis=0)
        np.add.at(g_s, z, g_z.T @ x)
        g = {
            "r": g_near @ w["near"].T + g_far @ w["far"].T,
            "near": w["r"].T @ g_near,
            "far": w["r"].T @ g_far,
            "s": g_s,
            "b": np.bincount(t, g_t, classes) + np.bincount(z, g_z.sum(axis=0), classes),
        }
        rate = 0.02 * min(1.0, 2 * (1 - begun - (ended - begun) * step / (steps + 1)))
        n, size = before + step, np.float32(1 / max(1.0, own.sum()))
        for k in w:
            d = g[k].astype(np.float32) * size
            first, second = state.first[k], state.second[k]
            first *= np.float32(0.9)
            first += np.float32(0.1) * d
            second *= np.float32(0.99)
            d *= d
            second += np.float32(0.01) * d
            w[k] -= np.float32(-rate / (1 - 0.9**n)) * first / (np.sqrt(second * np.float32(1 / (1 - 0.99**n))) + np.float32(1e-8))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values of each row."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    found = rows[order]
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[found[starts]] = np.add.reduceat(values[order], starts)
    return out


def fitted(rows: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """The weights after every place of rows (slot, classes) of `coded`."""
    spark, counts = rows.sparkSession, model.class_counts()
    steps = int(STEPS * grown(model.tokens))
    tasks = max(1, round(model.tokens / (steps * RUNS * RUN)))
    rounds = ROUNDS if tasks > 1 else 1
    state = State.begun(counts)
    for k in range(rounds):
        own = rows.where(F.col("slot") == k) if rounds > 1 else rows
        # a task's texts by their classes: one task's result does not depend on how the texts lay
        own = own.select("classes").repartition(tasks).sortWithinPartitions("classes")
        sent = spark.sparkContext.broadcast(state.flat)
        ended = own.mapInArrow(_fitter(sent, counts, steps, k, rounds), "part int, task int, n long, state binary")
        found = ended.groupBy("part").applyInPandas(_mean, "part int, state binary").collect()  # PARTS rows
        if found:
            state = State(len(counts), np.concatenate([np.frombuffer(r["state"], np.float32) for r in sorted(found, key=lambda r: r["part"])]))
        sent.unpersist()
    return state.w


def _fitter(sent, counts: np.ndarray, steps: int, k: int, rounds: int):
    """Round k of a task: from the sent numbers on through all of its places; what it ends with, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(x.as_py(), np.uint16) for batch in batches for x in batch.column(0)]
        if not found:
            return
        codes = np.concatenate(found)
        task = TaskContext.get().partitionId()
        state = State(len(counts), sent.value.copy())
        own = -(-len(codes) // (RUNS * RUN))
        fit(state, codes, counts, own if rounds > 1 else max(steps, own), k / rounds, (k + 1) / rounds, k * steps // rounds, 1000 * task + k)
        cuts = np.array_split(state.flat, PARTS)
        columns = [pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int32()), pa.array([len(codes)] * PARTS, pa.int64()), pa.array([c.tobytes() for c in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "task", "n", "state"])

    return run


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    """The mean of a part over tasks, by their numbers of places."""
    group = group.sort_values("task")
    share = group["n"].to_numpy() / group["n"].sum()
    total = sum(np.frombuffer(x, np.float32) * y for x, y in zip(group["state"], share, strict=True))
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "state": [total.astype(np.float32).tobytes()]})


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the texts, and (word, n) of all their words, written to the shared folder."""
    counts = written(word_counts(docs, text_col), "word-counts")
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == END).first()
    found = _head(counts.where(F.col("word") != END), HEAD).toArrow()  # HEAD rows at most
    head = list(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))
    head.sort(key=lambda x: (-x[1], x[0].encode("utf-8")))
    del found
    n_words = min(int(WORDS * grown(total[0] or 0)), len(head))
    spark = docs.sparkSession
    own = spark.createDataFrame([(w,) for w, _ in head[:n_words]] + [(END,)], "word string")  # as many rows as words have classes
    rest = counts.join(F.broadcast(own), "word", "left_anti").groupBy(bucket_col(F.col("word")).alias("k"))
    sums = np.zeros((BUCKETS, 2))
    for row in rest.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sums[row["k"]] = row["n"], row["v"]
    model = Model(total[0] or 0, total[1], head, n_words, ends["n"] if ends else 0, sums)
    rows = written(coded(docs, model, text_col), "coded", ("slot",))
    model.weights = fitted(rows, model)
    removed(rows)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): log10 probabilities of whole texts, by smoothed counts (base_score) and by the model (score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.ready()
        places, of = m.lookup()
        head = pa.array(list(places), pa.string())
        known = np.log10(np.array([c for _, c in m.head], np.float64) + 0.1)
        of_bucket = np.log10(m.bucket_counts[:, 0] + 0.1 * (m.bucket_counts[:, 1] + 1))
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for part in groups(batch.column(1), SCORED_BYTES):
                keys = np.arange(done, done + len(part)) + (task << 33)
                yield _scored(m, part, batch.column(0).slice(at, len(part)), keys, head, of, known, of_bucket)
                at, done = at + len(part), done + len(part)

    head = "struct<doc_id: long, n_tokens: long, n_known: long, base_score: double, score: double>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"key long, head {head}, rest array<struct<word: string, n: long>>"
    )
    # a row for each of a text's words outside the head; the first brings the text's own figures along
    each = rows.select("key", "head", F.posexplode("rest").alias("at", "x")).select(
        "key", F.when(F.col("at") == 0, F.col("head")).alias("head"), F.col("x.word").alias("word"), F.col("x.n").alias("times")
    )
    c = F.coalesce(F.col("n"), F.lit(0))
    joined = each.join(counts.where(F.col("word") != END), "word", "left").groupBy("key").agg(
        F.max("head").alias("head"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(c + F.lit(0.1).cast("double"))).alias("logs"),
    )
    return joined.select(
        "head.doc_id",
        "head.n_tokens",
        (F.col("head.n_known") + F.col("known")).alias("n_known"),
        (F.col("head.base_score") + F.col("logs")).alias("base_score"),
        (F.col("head.score") + F.col("logs")).alias("score"),
    )


def _scored(m: Model, texts: pa.Array, doc_ids: pa.Array, keys: np.ndarray, head: pa.Array, of: np.ndarray, known: np.ndarray, of_bucket: np.ndarray) -> pa.RecordBatch:
    """(key, head, rest) of texts: what the model and the head give, and the words outside the head with their numbers."""
    words, ends = words_in(texts)
    words = words.dictionary_encode()
    class_of, place_of = m.classes_of(words.dictionary, head, of)
    codes = words.indices.to_numpy()
    at, starts = stream(ends, len(codes))
    own = at >= 0
    classes, place = np.zeros(len(at), np.int64), np.full(len(at), -2, np.int64)
    classes[own], place[own] = class_of[codes], place_of[codes]
    near = np.append(0, classes[:-1])
    far = np.append(0, near[:-1])
    near[starts] = far[starts] = 0
    in_head, in_bucket = place >= 0, classes > m.n_words
    logs = np.zeros(len(at))
    logs[in_head] = known[place[in_head]]
    scores = m.log_probabilities(far, near, classes)
    scores[in_bucket] += logs[in_bucket] - of_bucket[classes[in_bucket] - 1 - m.n_words]
    total = lambda x: np.add.reduceat(x, starts)
    sizes = np.diff(np.append(starts, len(at)))
    base = total(logs) + np.log10(m.end_count + 0.1) - np.log10(m.tokens + 0.1 * (m.distinct + 1)) * sizes
    own_figures = [doc_ids, pa.array(sizes), pa.array(total(in_head.astype(np.int64)) + int(m.end_count > 0)), pa.array(base), pa.array(total(scores))]
    # each text's other words once; a text without any has a row all the same, under a word that no text holds
    doc = np.repeat(np.arange(len(texts)), sizes)[own]
    out = place_of[codes] < 0
    pair, n = np.unique(doc[out] * len(words.dictionary) + codes[out], return_counts=True)
    tail_doc, tail_code = pair // max(1, len(words.dictionary)), pair % max(1, len(words.dictionary))
    bare = np.setdiff1d(np.arange(len(texts)), tail_doc)
    tail = pa.concat_arrays([words.dictionary.take(pa.array(tail_code)), pa.array([f" {k}" for k in keys[bare]], pa.string())])
    order = np.argsort(np.append(tail_doc, bare), kind="stable")
    rest = pa.StructArray.from_arrays([tail, pa.array(np.append(n, np.zeros(len(bare), np.int64)))], ["word", "n"]).take(pa.array(order))
    offsets = np.append(0, np.cumsum(np.bincount(np.append(tail_doc, bare), minlength=len(texts))))
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.StructArray.from_arrays(own_figures, names), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)], ["key", "head", "rest"])
