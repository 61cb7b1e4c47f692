"""A stored vector index: exact largest inner products, with blocks left unread that their bounds rule out.

A batch's vectors are dealt to the nearest of up to CELLS centres, drawn from the batch by hash, and written in the
order of cell and distance; BLOCK rows in that order, or those of one cell among them, are a block, of which `bounds`
keeps the mean and the largest distance from it. No vector of a block can have a larger product with q than q * mean + |q| * distance. A search ranks
blocks by that, scores the first FIRST, then those whose bound reaches the k-th best score, GROWTH times as many a
round at most: the result is that of scoring all. Scope, tags and rows that later writes replaced are left out before
the k best are chosen; replaced rows are told by (entry_id, seq).

A batch is in the index when its mark is there, which is made last.

Defined cases: rows without vectors, or with another number of components than q, take no part; bounds of vectors of
several widths are kept apart; null or non-finite components are as good as no vector; equal scores go by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.textops import has_all_tags
from wrenfold.functions.vectors import dot

#: Centres of a batch, at most; rows of a block; blocks scored first, and how many times more in a further round.
CELLS, BLOCK, FIRST, GROWTH = 256, 512, 8, 8

ROWS = "entry_id string, seq long, project_scope string, tags array<string>, embedding array<float>, cell int, far double"
BOUNDS = "block long, width int, mean array<double>, radius double, n long"


@dataclass
class Nearest:
    """The k best (id, seq, score), and blocks that there are and that were scored."""

    hits: list[tuple[str, int, float]]
    blocks: int
    scored_blocks: int


def _usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _celled(centres: dict[int, np.ndarray], at: int):
    """Adds the nearest centre of a vector's width, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.zeros(len(b), np.int32), np.zeros(len(b))
            vectors = b.column(at)
            widths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(widths) - widths
            for width, c in centres.items():
                rows = np.flatnonzero(widths == width)
                x = flat[starts[rows, None] + np.arange(width)]
                apart = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))
                cell[rows] = apart.argmin(axis=1)
                far[rows] = apart[np.arange(len(rows)), cell[rows]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return run


def _bounds(table: pa.Table) -> pa.Table:
    """Mean and largest distance from it of a block's vectors, by width."""
    vectors = table["embedding"].combine_chunks()
    out = []
    by_width: dict[int, list] = {}
    for v in vectors.to_pylist():
        by_width.setdefault(len(v), []).append(v)
    for width, some in by_width.items():
        x = np.array(some, np.float64)
        mean = x.mean(axis=0)
        # a little more than the distance, so that rounding cannot rule a vector out
        radius = float(np.sqrt(((x - mean) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-9 * float(np.abs(x).max())
        out.append((table["block"][0].as_py(), width, mean.tolist(), radius, len(some)))
    types = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "width", "mean", "radius", "n"])


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        at, fs = self._at("batch=*/_WHOLE")
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in fs.globStatus(at) or [])

    def add(self, rows: DataFrame, batch: int, gone: DataFrame) -> None:
        """Indexes a batch's rows (entry_id, seq, project_scope, tags, embedding), and notes rows (entry_id, seq) as replaced."""
        rows = rows.where(_usable(F.col("embedding"))).select(*[c.split()[0] for c in ROWS.split(", ")][:5])
        n = rows.count()
        # a bounded draw: the least hashes, the same whatever the order of rows
        drawn = rows.orderBy(F.xxhash64("entry_id", "seq")).limit(min(CELLS, max(1, -(-n // BLOCK)))).select("embedding").collect()
        centres: dict[int, list] = {}
        for r in drawn:
            centres.setdefault(len(r[0]), []).append(r[0])
        celled = rows.mapInArrow(_celled({w: np.array(c, np.float64) for w, c in centres.items()}, 4), ROWS)
        draft, folder = f"{self.root}/draft-{uuid.uuid4().hex}", f"{self.root}/batch={batch}"
        celled.repartitionByRange("cell", "far").sortWithinPartitions("cell", "far").withColumn("at", F.monotonically_increasing_id()).write.parquet(draft)
        # numbered when written, so a task that runs again reads the same numbers
        place = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK)
        block = F.lit(batch << 44) + F.shiftrightunsigned("at", 33) * (1 << 28) + place * CELLS + F.col("cell")  # of one cell each
        staged = self.spark.read.schema(f"{ROWS}, at long").parquet(draft).withColumn("block", block.cast("long")).drop("at", "cell", "far")
        staged.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{folder}/vectors")
        kept = self.spark.read.schema(staged.schema).parquet(f"{folder}/vectors")
        kept.select("block", "embedding").groupBy("block").applyInArrow(lambda t: _bounds(t), BOUNDS).write.mode("overwrite").parquet(f"{folder}/bounds")
        gone.select("entry_id", F.col("seq").cast("long")).write.mode("overwrite").parquet(f"{folder}/gone")
        at, fs = self._at(draft.removeprefix(self.root + "/"))
        fs.delete(at, True)
        at, fs = self._at(f"batch={batch}/_WHOLE")
        fs.create(at, True).close()

    def _read(self, kind: str, schema: str) -> DataFrame:
        found = [f"{self.root}/batch={b}/{kind}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def search(self, query: list[float], k: int, floor: float, scope: str | None = None, tags: list[str] = []) -> Nearest:  # noqa: B006
        """The k rows in force of the largest inner product with the query, of those at least `floor`."""
        if not query or k < 1:
            return Nearest([], 0, 0)
        size = float(np.sqrt(np.square(np.asarray(query, np.float64)).sum()))
        asked = F.array(*[F.lit(float(x)) for x in query])
        bounds = self._read("bounds", BOUNDS)
        ranked = bounds.where(F.col("width") == len(query)).select("block", (dot(F.col("mean"), asked) + F.lit(size) * F.col("radius")).alias("most")).persist()
        total = ranked.count()
        gone = self._read("gone", "entry_id string, seq long")
        rows = self._read("vectors", "entry_id string, seq long, project_scope string, tags array<string>, embedding array<float>, block long").where(F.size("embedding") == len(query))
        if scope is not None:
            rows = rows.where(F.col("project_scope") == scope)
        if tags:
            rows = rows.where(has_all_tags(F.col("tags"), tags))
        best: list[tuple[str, int, float]] = []
        done, cut, take = 0, None, FIRST
        while done < total:
            left = ranked if cut is None else ranked.where(F.col("most") < cut)
            least = max(floor, best[-1][2]) if len(best) == k else floor
            # rounding of either side must not rule a block out
            left = left.where(F.col("most") >= least - 1e-6 * (1 + abs(least)))
            n = left.count()
            if not n:
                break
            cut = left.orderBy(F.desc("most")).limit(take).agg(F.min("most")).first()[0]
            chosen = left.where(F.col("most") >= cut)
            done += chosen.count()
            scored = rows.join(chosen.select("block"), "block").select("entry_id", "seq", dot(F.col("embedding"), asked).alias("score")).where(F.col("score") >= floor)
            scored = scored.join(gone, ["entry_id", "seq"], "left_anti").orderBy(F.desc("score"), "entry_id").limit(k)
            best = sorted([*best, *map(tuple, scored.collect())], key=lambda x: (-x[2], x[0]))[:k]
            if len(best) == k:
                take *= GROWTH
        ranked.unpersist()
        return Nearest(best, total, done)
