"""Near duplicates by the Jaccard similarity of word shingles: SimHash and MinHash find the pairs, shingle sets decide them.

Texts of equal shingle sets are one. Candidates are, first, sets whose texts' fingerprints operator 5 links (simhash.links,
at LIMIT bits), and those of one fingerprint. As 64 bits miss most pairs at such a similarity, pairs that share a band are
candidates too. Of each set, ROWS least hashes under ROWS multipliers make a band, and two sets
that share one of BANDS bands are candidates: at a similarity of 0.8 a pair misses all bands with a chance of
(1 - 0.8**6)**40, about 5e-6; at 0.3, as texts that share a passage have, 3 % of pairs are candidates. Candidates are joined into components by stars, which may hold too much, never too
little; within a component every pair that no links join yet is compared by its whole sets, and the pairs that reach
the similarity are the links. A component of more than CHUNK sets is cut into chunks, and each pair of chunks is a
task's work of its own. So no step makes a row for every pair of a large group.

Defined cases: words and short texts are those of simhash; null and blank texts have the empty set and are copies of
each other; a null id is linked but is never a component's name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from wrenfold.llm import simhash
from wrenfold.llm.common import written
from wrenfold.llm.simhash import _hashes, components

BANDS, ROWS = 40, 6
#: Differing bits of linked fingerprints.
LIMIT = 3
#: Sets of a component that one task compares with each other, or with as many others.
CHUNK = 2048
_MULTIPLIERS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(_hashes(text, size))


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The set's band keys; the empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_MULTIPLIERS), ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(least, (_MULTIPLIERS[:, None] * hashes[None, at : at + 512]).min(axis=1), out=least)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def _sets(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """The columns of rows, of which doc holds the text, the id of the text's shingle set, its fingerprint and its bands."""
    at = rows.columns.index("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, keys = [], [], []
            for x in batch.column(at).field(text_col):
                whole = _hashes(x.as_py(), size)
                prints.append(simhash.print_of(whole))
                hashes = np.unique(whole)
                ids.append(set_id(hashes))
                keys.append(bands(hashes))
            sizes = np.cumsum([0, *map(len, keys)])
            more = [pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "set", "fp", "bands"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("set", LongType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))]))


def compare(sets: list[np.ndarray], right: np.ndarray | None, least: float) -> np.ndarray:
    """For each of the (not empty) sets, the number of one that links of at least that similarity join it to.

    right None: all pairs are compared; else only those of a set outside and one inside right.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    side = None if right is None else right[order]
    mark, root = np.zeros(flat.max() + 1, np.uint8), np.arange(len(sets))
    ends = np.searchsorted(sizes, sizes / least * (1 + 1e-9), side="right")  # beyond, the sizes alone forbid a link
    for i, end in enumerate(ends):
        wanted = root[i + 1 : end] != root[i]
        if side is not None:
            wanted &= side[i + 1 : end] != side[i]
        if not wanted.any():
            continue
        lo, hi = i + 1 + np.flatnonzero(wanted)[[0, -1]] + [0, 1]
        mine = flat[starts[i] : starts[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[mine] = 0
        near = wanted[lo - i - 1 : hi - i - 1] & (common / (sizes[i] + sizes[lo:hi] - common) >= least)
        if near.any():
            root[np.isin(root, root[lo:hi][near])] = root[i]
    out = np.empty(len(sets), np.int64)
    out[order] = order[root]
    return out


def _comparer(size: int, least: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, low, high = pair
        ids = group["set"].to_numpy(np.int64)
        right = None if low == high else group["mine"].to_numpy() == high
        other = ids[compare([shingles(t, size) for t in group["text"]], right, least)]
        far = ids != other
        return pd.DataFrame({"a": np.minimum(ids, other)[far], "b": np.maximum(ids, other)[far]})

    return run


def alike(reps: DataFrame) -> DataFrame:
    """Stars (a, b), a < b, of the sets of reps (set, fp) whose fingerprints operator 5 links, or that share one."""
    prints = reps.groupBy("fp").agg(F.min("set").alias("a"))
    same = reps.select("fp", F.col("set").alias("b")).join(prints, "fp").select("a", "b")
    near = simhash.links(prints.select("fp"), LIMIT)
    left, right = (prints.select(F.col("fp").alias(c), F.col("a").alias(f"set_{c}")) for c in ("a", "b"))
    near = near.join(left, "a").join(right, "b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
    return same.unionByName(near).where("a < b").distinct()


def links(texts: DataFrame, reps: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b), a < b, that join the sets connected at that similarity.

    texts: (row, text); reps: (set, row, fp, bands), row one that has the set. Texts meet the candidates by a shuffle at
    every size, so that what is measured on small tables is the plan of large ones.
    """
    keys = reps.select("set", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a < b").select("key", "a")
    stars = keys.withColumnRenamed("set", "b").join(shared, "key").where("a < b").select("a", "b")
    # the empty set is like none, and has no bands
    stars = stars.unionByName(alike(reps.where(F.size("bands") > 0).select("set", "fp"))).distinct()
    found = written(components(stars), "candidates")
    heavy = found.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    found = found.join(heavy, "label").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    found = reps.join(found, reps["set"] == found["node"]).select("row", "set", "label", "mine", "chunks")
    rows = texts.hint("merge").join(found, "row")
    rows = rows.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("label", F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high"), "mine", "set", "text")
    return rows.groupBy("label", "low", "high").applyInPandas(_comparer(size, least), "a long, b long").distinct()


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each component: of the least id (if any row has one), then of the least text.

    Who stays is decided on narrow rows. Whole documents are shuffled once, to meet the rows that go.
    """
    text = F.col("doc").getField(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.struct(*docs.columns).alias("doc"))
    sets = written(_sets(rows, text_col, size), "shingle-sets")
    reps = written(sets.groupBy("set").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-sets")
    labels = components(links(sets.select("row", text.alias("text")), reps.select("set", "row", "fp", "bands"), size, least))
    named = reps.join(labels, reps["set"] == labels["node"], "left").select("set", "first", F.coalesce("label", "set").alias("label"))
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    members = sets.select("row", "doc_id", "set").join(named.join(names, "label").select("set", "label", "component_id"), "set")
    members = written(members.select("row", "label", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("named")), "members")
    # of most components just one row has the component's id; of the others the text decides
    stay = members.where("named").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    tied = written(members.where("named").join(stay.where("n > 1").select("label"), "label", "left_semi").select("row", "label"), "tied")
    chosen = sets.select("row", text.alias("text")).join(tied, "row").groupBy("label").agg(F.min_by("row", F.struct("text", "row")).alias("row"))
    stay = stay.where("n = 1").select("row").unionByName(chosen.select("row"))
    go = members.select("row").join(stay, "row", "left_anti")
    return sets.select("row", "doc").hint("merge").join(go, "row", "left_anti").select("doc.*")
