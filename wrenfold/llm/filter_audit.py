"""Audit of how filters interact: what each removes in every order of applying them.

A document's failures are a bit mask, so whatever an order of filters does to a part is a sum over the part's mask
counts. All filters but the last read the document alone. The last, for copies, needs the least id of equal texts:
texts are routed by their XXH64 to the partition that owns the fingerprint, where a chain for each fingerprint keeps
every different text with its least id, so that a collision joins nothing; ids that are not the least are emitted
as soon as they are known. combineByKey then merges vectors of mask counts by part.

Hot texts: a mapping task holds up to HELD bytes of texts that it has met, and decides on the spot every row whose
id is not the least of its own rows of that text. What travels with its text is one entry for each text, task and
filling of those bytes; decided rows travel without it, dealt by their id. The number of partitions follows from
the bytes of all texts, so that a partition's chains have a bound. Hot parts and ids are counted before they move.

Defined cases: a null text is empty, a null source the empty string; a row with a null doc_id is no copy, is no
one's original and has no labels; of rows with one text and the same least id none is a copy; a document with
several rows of labels is good, or toxic, if any says so; very long texts are read whole; an empty table gives no
rows; other columns of the inputs are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Bytes of texts that a mapping task holds, and those that a partition of chains gets, about.
HELD, ROUTED = 16 << 20, 24 << 20
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"

#: Whether a document fails, from its text, the text's bytes and its words (runs of anything but ASCII blanks).
Condition = Callable[[str, bytes, list[bytes]], bool]
CONDITIONS: dict[str, Condition] = {
    "A": lambda text, raw, words: len(words) < 50,
    "B": lambda text, raw, words: 100 * len(set(words)) < 65 * len(words),
    "C": lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text),
    "D": lambda text, raw, words: len(raw.translate(None, _MARKS)) < len(raw),
}
#: The letter of the filter for copies, which comes last.
COPIES = "E"
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _decided(rows: Iterable[Row], conditions: list[Condition]) -> Iterator[tuple[int, tuple]]:
    """(key, (doc_id, text or None, mask, count by part)) of a task: keyed by fingerprint with the text, else by id."""
    copy = 1 << len(conditions)
    held: dict[bytes, list] = {}
    size = 0
    for doc_id, text, part in rows:
        text = text or ""
        raw = text.encode()
        known = held.get(raw) if doc_id is not None else None
        if known is not None:
            least, mask, parts = known
            if doc_id == least:
                parts[part] += 1
            elif doc_id > least:
                yield hash(doc_id), (doc_id, None, mask | copy, {part: 1})
            else:
                yield hash(least), (least, None, mask | copy, dict(parts))
                held[raw] = [doc_id, mask, Counter((part,))]
            continue
        words = raw.split()
        mask = sum(1 << k for k, fails in enumerate(conditions) if fails(text, raw, words))
        if doc_id is None:
            yield xxhash.xxh64_intdigest(part), (None, None, mask, {part: 1})
            continue
        held[raw] = [doc_id, mask, Counter((part,))]
        size += len(raw) + 200
        if size > HELD:
            yield from _entries(held)
            held, size = {}, 0
    yield from _entries(held)


def _entries(held: dict[bytes, list]) -> Iterator[tuple[int, tuple]]:
    for raw, (doc_id, mask, parts) in held.items():
        yield xxhash.xxh64_intdigest(raw), (doc_id, raw, mask, dict(parts))


def _chained(entries: Iterable[tuple[int, tuple]], copy: int) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of a partition, with the bit of copies where the id is not the least of its text."""
    chains: dict[int, list[list]] = {}
    for key, (doc_id, raw, mask, parts) in entries:
        if raw is None:
            yield from ((doc_id, p, mask, n) for p, n in parts.items())
            continue
        chain = chains.setdefault(key, [])
        link = next((x for x in chain if x[0] == raw), None)
        if link is None:
            chain.append([raw, doc_id, mask, Counter(parts)])
        elif doc_id == link[1]:
            link[3].update(parts)
        else:
            if doc_id < link[1]:
                link[1], doc_id, link[3], parts = doc_id, link[1], Counter(parts), link[3]
            yield from ((doc_id, p, mask | copy, n) for p, n in parts.items())
    for chain in chains.values():
        for _, doc_id, mask, parts in chain:
            yield from ((doc_id, p, mask, n) for p, n in parts.items())


def masks(docs: DataFrame, conditions: dict[str, Condition] = CONDITIONS, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): n documents of that id and part fail the filters whose bits the mask holds."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.coalesce(F.col(part_col).cast("string"), F.lit("")))
    size = rows.agg(F.sum(F.octet_length(F.col(rows.columns[1])))).first()[0] or 0
    spark = docs.sparkSession
    tests, copy = list(conditions.values()), 1 << len(conditions)
    partitions = max(spark.sparkContext.defaultParallelism, -(-size // ROUTED))
    routed = rows.rdd.mapPartitions(lambda r: _decided(r, tests)).partitionBy(partitions, lambda key: key)
    found = routed.mapPartitions(lambda e: _chained(e, copy))
    narrow = spark.createDataFrame(found, "doc_id long, part string, mask int, n long", verifySchema=False)
    return narrow.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def _steps(letters: str) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Each (order, step), and which masks are left after it, which fail its filter, and its filter's share of them."""
    bits = np.arange(1 << len(letters))
    names, kept, fails, share = [], [], [], []
    orders = ["".join(p) for p in permutations(letters)]
    held = np.bitwise_count(bits).astype(np.int64)
    for order in orders:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            before |= bit
            names.append((order, step))
            kept.append(bits & before == 0)
            fails.append(bits & bit != 0)
            # of all orders, one in as many as a mask has bits puts this filter before its others
            share.append(np.where(bits & bit, len(orders) // np.maximum(held, 1), 0))
    return names, np.array(kept).astype(np.int64), np.array(fails).astype(np.int64), np.array(share)


def _report(letters: str) -> Callable[[tuple], Iterator[tuple]]:
    """The rows of a part from its three vectors of mask counts: all documents, good ones, toxic ones."""
    names, kept, fails, share = _steps(letters)
    alone = np.bitwise_count(np.arange(1 << len(letters))) == 1

    def run(item: tuple) -> Iterator[tuple]:
        part, counts = item
        left = kept @ counts.T  # a row a step, columns: all, good, toxic
        was = np.vstack([counts.sum(axis=1), left[:-1]])
        was[:: len(letters)] = counts.sum(axis=1)
        lost = was - left
        failing, sole, value = fails @ counts[0], (fails * alone) @ counts[0], share @ counts[0]
        for k, (order, step) in enumerate(names):
            yield (
                part, order, step, int(left[k, 0]), int(lost[k, 0]), int(failing[k] - lost[k, 0]),
                int(sole[k]), int(lost[k, 1]), int(lost[k, 2]), int(value[k]),
            )

    return run


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Condition] = CONDITIONS,
    text_col: str = "text",
    id_col: str = "doc_id",
    part_col: str = "source",
) -> DataFrame:
    """AUDIT rows: for each part, order of the filters and step, what the step's filter does there.

    labels: (doc_id, quality, toxic), of which 1 marks a good, and a toxic, document. Filters are few: a part has a
    vector of 2 to their number, and their number's factorial of orders.
    """
    letters = "".join(conditions) + COPIES
    width = 1 << len(letters)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    found = masks(docs, conditions, text_col, id_col, part_col).join(flags, "doc_id", "left")
    counted: RDD = found.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], r[1:]))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[0, mask] += n
        counts[1, mask] += n if good else 0
        counts[2, mask] += n if toxic else 0
        return counts

    vectors = counted.combineByKey(lambda row: add(np.zeros((3, width), np.int64), row), add, lambda a, b: a + b)
    return docs.sparkSession.createDataFrame(vectors.flatMap(_report(letters)), AUDIT, verifySchema=False)
