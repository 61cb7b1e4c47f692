"""SimHash near duplicates: 64-bit fingerprints, linked at a few differing bits by a binary trie self-join.

A fingerprint is made from the XXH64 of a text's word shingles, repeats included. Distinct fingerprints (copies
of a text share one) form a binary trie. The join walks pairs of nodes of equal depth together, starting at the
root with itself; each step takes both to their children, adds a bit where these differ, and drops a pair that
exceeds the error budget. The 64 bits are cut into limit // 2 + 1 parts; of two words of `limit` differing bits or
fewer, one part has one of them at most (parts()). So the trie is walked once from each part first, with that as the
budget of the part and limit as that of the whole. The walks together lose no link and stay near the diagonal.

On Spark, the first levels of the walk are the shuffle: every fingerprint goes to the node pairs that its prefix
belongs to within the first budget. Their number follows from the count of fingerprints, so that a node holds
some thousands; a heavier node is cut into chunks, and each pair of chunks is a task's work of its own. A task
walks on below with numpy, depth first in slices, so its memory is bounded. It returns a spanning forest of its
links, not the links, and star-shaped label propagation joins these into components.

Defined cases: a null or blank text has no shingle and the fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows each get their row; a null doc_id is linked but is never
a component's name, which is null if no row of the component has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wrenfold.llm.common import removed, written

#: Fingerprints that a trie node of the shuffle holds, about; beyond CHUNK times as many it is cut.
NODE_ROWS, CHUNK = 2048, 8
#: Pairs of nodes that a walk holds at once.
SLICE = 1 << 17


def _hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    if size == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return np.fromiter((h(g, 42) for g in grams), np.uint64, len(grams))


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return print_of(_hashes(text, size))


def print_of(hashes: np.ndarray) -> int:
    """The same of its shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns to carry, fp), fp a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), size) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], [*batch.schema.names[1:], "fp"])

    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *carry)
    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], StructField("fp", LongType())]))


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Merges the sets that root keeps (each element's smallest known member) along the links a-b."""
    while len(a):
        ra, rb = root[a], root[b]
        far = ra != rb
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def parts(limit: int) -> tuple[int, int, int]:
    """How many walks there are, the levels of the part that each begins with, and that part's budget."""
    n = limit // 2 + 1
    return n, 64 // n, limit // n


def walk(left: np.ndarray, right: np.ndarray | None, budgets: tuple[int, int], depth: int, root: np.ndarray, width: int = 32) -> None:
    """Walks the tries of two sorted arrays of distinct keys (right None: left with itself) and merges links in root.

    Keys are unsigned, ordered from their first trie level. budgets: differing bits over the first `width`
    levels, and over all. root covers left, then right. A node is a range of keys; a pair of nodes that hold one key each is
    compared at once.
    """
    keys = left if right is None else np.concatenate([left, right])
    n_left = len(left)
    if not len(left) or (right is not None and not len(right)):
        return
    start = (0, n_left, 0, n_left) if right is None else (0, n_left, n_left, len(keys))
    stack = [(np.array([[*start]], np.int64), depth)]
    first, total = budgets
    while stack:
        nodes, level = stack.pop()
        if len(nodes) > SLICE:
            stack += [(nodes[i : i + SLICE], level) for i in range(0, len(nodes), SLICE)]
            continue
        a0, a1, b0, b1 = nodes.T
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any() or level == 64:
            small |= level == 64
            s = nodes[small]
            na, nb = s[:, 1] - s[:, 0], s[:, 3] - s[:, 2]
            each = na * nb
            at = np.repeat(np.arange(len(s)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = s[at, 0] + k // nb[at], s[at, 2] + k % nb[at]
            x = keys[i] ^ keys[j]
            near = (i != j) & (np.bitwise_count(x) <= total) & (np.bitwise_count(x >> np.uint64(64 - width) if width < 64 else x) <= first)
            _forest(len(keys), i[near], j[near], root)
            nodes = nodes[~small]
            if not len(nodes):
                continue
            a0, a1, b0, b1 = nodes.T
        # the children of a node part at the first key whose bit of this level is set
        bit = np.uint64(1) << np.uint64(63 - level)
        a, b = _part(keys, a0, a1, bit), _part(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        children = [(a0, a, b0, b), (a, a1, b, b1), (a0, a, b, b1)]
        pairs = [np.stack(c, axis=1) for c in children]
        crossed = np.stack((a, a1, b0, b), axis=1)[~same]
        nxt = np.concatenate([*pairs, crossed])
        nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2])]
        x = (keys[nxt[:, 0]] ^ keys[nxt[:, 2]]) >> np.uint64(63 - level)  # the bits of the path so far
        shown = level + 1
        ok = np.bitwise_count(x) <= total
        ok &= np.bitwise_count(x >> np.uint64(max(0, shown - width))) <= first
        stack.append((nxt[ok], level + 1))


def _part(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """For each range of sorted keys that agree above the bit, the place of the first that has it."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        set_ = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)


def _rotated(fp: Column, left: int) -> Column:
    return F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left)) if left else fp


def _node_rows(reps: DataFrame, depth: int, turn: int, heavy: DataFrame, limit: int) -> DataFrame:
    """A row for each pair of nodes, and pair of chunks, that a fingerprint belongs to: (p, q, cp, cq, right, key)."""
    rows = reps.select(_rotated(F.col("fp"), turn).alias("key")).withColumn("node", F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long"))
    masks = [0]
    for _ in range(parts(limit)[2]):
        masks = sorted({m ^ (1 << i) for m in masks for i in range(depth)} | set(masks))
    rows = rows.select("key", "node", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    rows = rows.withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    n = lambda node: heavy.select(F.col("node").alias(node), F.col("chunks").alias(f"{node}_chunks"))
    # few nodes of evenly spread fingerprints are heavy; where many are, the joins shuffle
    few = F.broadcast if heavy.count() <= 100_000 else lambda x: x
    rows = rows.join(few(n("node")), "node", "left").join(few(n("other")), "other", "left")
    mine, theirs = (F.coalesce(F.col(c), F.lit(1)) for c in ("node_chunks", "other_chunks"))
    rows = rows.select(
        "key", "node", "other", F.pmod(F.xxhash64("key"), mine).cast("int").alias("mine"),
        F.explode(F.sequence(F.lit(0), theirs.cast("int") - 1)).alias("theirs"),
    )
    # the pair, with the lesser node, or of one node the lesser chunk, on the left
    swap = (F.col("node") > F.col("other")) | ((F.col("node") == F.col("other")) & (F.col("mine") > F.col("theirs")))
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return rows.select(
        either("node", "other").alias("p"), either("other", "node").alias("q"),
        either("mine", "theirs").alias("cp"), either("theirs", "mine").alias("cq"),
        swap.alias("right"), "key",
    )


def _walker(depth: int, turn: int, limit: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a task does with a pair of nodes, or of chunks of nodes: walk it, and return its forest."""

    def run(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p, q, cp, cq = pair
        keys = group["key"].to_numpy().astype(np.int64).view(np.uint64)
        if (p, cp) == (q, cq):
            left, right = np.unique(keys), None
            both = left
        else:
            on_right = group["right"].to_numpy(bool)
            left, right = np.unique(keys[~on_right]), np.unique(keys[on_right])
            both = np.concatenate([left, right])
        root = np.arange(len(both))
        _, width, first = parts(limit)
        walk(left, right, (first, limit), depth, root, width)
        at = np.flatnonzero(root != np.arange(len(both)))
        x, y = both[at], both[root[at]]
        if turn:
            x, y = ((v >> np.uint64(turn)) | (v << np.uint64(64 - turn)) for v in (x, y))
        x, y = x.view(np.int64), y.view(np.int64)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def links(reps: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b), a < b, that join whatever fingerprints of reps (fp, distinct) are connected at limit bits.

    Each task returns a spanning forest of the links that it finds, as stars.
    """
    n = reps.count()
    walks, width, _ = parts(limit)
    depth = int(max(0, min(width, np.ceil(np.log2(max(1, n) / NODE_ROWS)))))
    found = []
    for turn in range(0, walks * width, width):  # each part in turn comes first
        key = _rotated(F.col("fp"), turn)
        node = F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")
        heavy = written(reps.groupBy(node.alias("node")).count().select(
            "node", F.ceil(F.col("count") / (CHUNK * NODE_ROWS)).cast("int").alias("chunks")
        ).where("chunks > 1"), "heavy-nodes")

        rows = _node_rows(reps, depth, turn, heavy, limit)
        found.append(rows.groupBy("p", "q", "cp", "cq").applyInPandas(_walker(depth, turn, limit), "a long, b long"))
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b), label the least node of its component.

    Alternately every node's larger, then smaller, neighbours are linked to the least one that it knows, until
    nothing changes; the links then are stars.
    """

    def hooked(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            pairs = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(least, "a")
        if larger:
            out = joined.where("b > a").select(F.col("m").alias("a"), "b")
        else:
            out = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return out.where("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return row[0], row[1]

    pairs = written(edges, "links")
    before = None
    while before != (now := state(pairs)):
        before, was = now, pairs
        pairs = written(hooked(hooked(pairs, True), False), "links")
        removed(was)
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        pairs.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3, limit: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns to carry, fp, label, component_id), a row for each row of docs.

    label names the component, by one of its fingerprints; component_id is the least doc_id in it.
    """
    prints = written(fingerprints(docs, text_col, id_col, size, carry), "fingerprints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    labels = components(links(reps.select("fp"), limit))
    named = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "label").select("fp", "label", "component_id"), "fp")
