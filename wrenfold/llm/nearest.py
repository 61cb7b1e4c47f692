"""Exact nearest neighbours of a set of queries by inner product: a block matrix join over int8 tiles.

Vectors are quantised to int8, each with its scale. Queries and candidates are dealt into blocks of a bounded size
by hash; a task gets a tile, the pair of a block of queries and a block of candidates. The product of the two int8
matrices (of small integers, so exact in a float32 matrix product) gives approximate inner products, and the
lengths of what quantisation lost a bound of their error. Pairs whose upper bound falls short of the k-th largest
lower bound of their query cannot be among its k nearest; the others are computed anew in double precision from
the original vectors, term after term, and the k best of each query kept in a heap. The tiles' heaps are merged by
query. As the bounds hold, the result is that of brute force.

Defined cases: vectors that are null, zero, or have null or non-finite components take no part, nor do rows
without an id; vectors of different lengths are not compared; equal scores go by the smaller id, and a score that is
no number (components so large that infinities of both signs add up) comes last; rows that share an id each ask with
their own vector, and are candidates of each other; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import written

#: Rows of a block of queries, and of candidates, about.
QUERY_BLOCK, BLOCK = 8192, 16384
#: Cells of a tile that are held at once.
CELLS = 1 << 22

NEAREST = "query_id long, rank int, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, each row's scale, and the length of each row's error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) * (1 + 1e-9)


def unit_scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows by powers of two, so that the largest component is from 0.5 to 1, and the powers' exponents."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -power[:, None]), power


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return total


def tile(
    q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
) -> list[tuple[int, list[tuple[float, int]]]]:
    """For each query's row its k best (score, -id) among the candidates, as a heap; a row is no candidate of itself.

    Rows are quantised at a power of two of their own. Bounds are compared at the query's power and the largest of
    the candidates, where one that is much smaller may vanish to zero with an error of that size, which is added. A
    score that overflows, or is not a number, has no bound that holds: such pairs always survive.
    """
    (q_unit, q_power), (c_unit, c_power) = unit_scaled(q), unit_scaled(c)
    qi, qs, qe = quantise(q_unit)
    ci, cs, ce = quantise(c_unit)
    rel = np.ldexp(1.0, np.maximum(c_power - c_power.max(), -1000)) if len(c) else np.ones(0)
    q_len, c_len = np.linalg.norm(q_unit, axis=1), np.linalg.norm(c_unit, axis=1)
    kind = np.float32 if q.shape[1] <= 1000 else np.float64  # sums of products stay below 2**24 in float32
    ci = ci.astype(kind).T
    out = []
    step = max(1, CELLS // max(1, len(c)))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        near = (qi[part].astype(kind) @ ci) * (qs[part, None] * (cs * rel)[None, :])
        # |xy - x'y'| <= |x||y-y'| + |x-x'||y'|, and |y'| <= |y| + |y-y'|
        error = q_len[part, None] * (ce * rel)[None, :] + qe[part, None] * ((c_len + ce) * rel)[None, :]
        error += 1e-12 * q_len[part, None] * (c_len * rel)[None, :] + 1e-290
        # products of components that leave the range of doubles are not what the bounds are of
        size = np.add.outer(q_power[part], c_power) + np.log2(max(2, q.shape[1]))
        loose = (size > 1020) | (size < -1000)
        own = q_rows[part, None] == c_rows[None, :]
        low = np.where(own | loose, -np.inf, near - error)
        n = low.shape[1]
        floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
        row, col = np.nonzero(((near + error >= floor[:, None]) | loose) & ~own)
        scores = _exact(q[part][row], c[col])
        ends = np.searchsorted(row, np.arange(len(low) + 1))
        for i in range(len(low)):
            mine = slice(ends[i], ends[i + 1])
            out.append((int(q_rows[at + i]), heapq.nlargest(k, zip(_ranked(scores[mine]).tolist(), (-c_ids[col[mine]]).tolist(), scores[mine].tolist(), strict=True))))
    return [(i, [(s, v) for _, v, s in best]) for i, best in out]


def _ranked(scores: np.ndarray) -> np.ndarray:
    """The scores in an order: a sum of infinities of both signs, which is no number, comes last."""
    return np.where(np.isnan(scores), -np.inf, scores)


def _tiler(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, float, int]] = []
        if left.num_rows and right.num_rows:
            q, c = _vectors(left), _vectors(right)
            ids = left.column("id").to_numpy()
            number = dict(zip(left.column("row").to_pylist(), ids.tolist(), strict=True))
            found = tile(left.column("row").to_numpy(), q, right.column("row").to_numpy(), right.column("id").to_numpy(), c, k)
            rows = [(number[i], i, s, -v) for i, best in found for s, v in best]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "row", "score", "vec_id"])

    return run


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def _merger(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int, float]]] = {}
        for b in batches:
            for q, r, s, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                heap, entry = heaps.setdefault((q, r), []), (s if s == s else -np.inf, -v, s)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
        rows = [(q, n, -v, s) for (q, _), heap in heaps.items() for n, (_, v, s) in enumerate(sorted(heap, key=lambda e: e[:2], reverse=True), 1)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, NaN or infinite component, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """NEAREST rows: for every row for which `queries` holds, its k nearest others, rank 1 the nearest."""
    vector_type = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(vector_type).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    # rows that are alike in id and vector still are rows of their own
    rows = written(rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    n, n_asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    q_blocks, blocks = max(1, -(-n_asks // QUERY_BLOCK)), max(1, -(-n // BLOCK))
    rows = rows.withColumn("h", F.xxhash64("row"))
    one = lambda blocks: F.pmod("h", F.lit(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.where("asks").select("id", "row", "v", "dim", one(q_blocks).alias("qb"), all_of(blocks).alias("cb"))
    given = rows.select("id", "row", "v", "dim", one(blocks).alias("cb"), all_of(q_blocks).alias("qb"))
    by = ["dim", "qb", "cb"]
    tiles = asked.groupBy(*by).cogroup(given.groupBy(*by)).applyInArrow(_tiler(k), "query_id long, row long, score double, vec_id long")
    return tiles.repartition(F.col("row")).mapInArrow(_merger(k), NEAREST)
