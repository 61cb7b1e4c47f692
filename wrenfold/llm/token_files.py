"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file is: zstandard frames, each the ids of consecutive documents as little-endian unsigned 32-bit integers; the
document table, in a skippable frame; the seek table of the public seekable format, in a last skippable frame,
with each frame's compressed and plain size and the low 32 bits of the XXH64 of its plain bytes. A plain
zstandard reader of the frames sees the ids alone. A long document spans frames. A reader takes the two tables
from the file's end and then decompresses just the frames that hold the documents asked for.

The documents are range-partitioned by id and sorted, each partition makes one file, and files are numbered in
the order of their ids, so the ids of all files one after another are in ascending doc_id order (null ids first,
equal ids by their text). A file is written under a name of the task attempt's own and then renamed: an attempt
that is lost leaves nothing that a reader takes, and its successor makes the same file.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own; an empty table
makes no documents; other columns are not written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.llm.tokens import le_bytes, word_encoder

#: Plain bytes after which a frame ends.
FRAME_BYTES = 1 << 20
#: Input that goes into a file, about.
FILE_BYTES = 1 << 29
#: Of the public format: skippable frames' numbers, and the seek table's.
SKIP_DOCS, SKIP_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_DOC = struct.Struct("<qQQB")  # id, first token in the file, tokens, whether the id is null


class FileWriter:
    """Writes documents' ids to a stream; close() adds the two tables."""

    def __init__(self, stream, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.size = [], 0
        self.docs, self.frames = [], []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(_DOC.pack(doc_id or 0, self.tokens, len(ids), doc_id is None))
        self.tokens += len(ids)
        raw = le_bytes(ids)
        while raw:
            part = raw[: self.frame_bytes - self.size]
            raw = raw[len(part) :]
            self.held.append(part)
            self.size += len(part)
            if self.size >= self.frame_bytes:
                self._frame()

    def _frame(self) -> None:
        plain = b"".join(self.held)
        self.held, self.size = [], 0
        packed = self.packer.compress(plain)
        self.stream.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame()
        table = self.packer.compress(b"".join(self.docs))
        self.stream.write(struct.pack("<II", SKIP_DOCS, len(table) + 8) + table + struct.pack("<Q", len(self.docs)))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(entries) + 9) + entries)
        self.stream.write(struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC))


class FileReader:
    """Reads documents by their place in the file. stream must be seekable."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        seek_at = size - 17 - 12 * n
        self.frames = np.frombuffer(self._at(seek_at + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        docs_at = int(self.packed_at[-1])
        table = self._at(docs_at + 8, seek_at - docs_at - 16)
        (count,) = struct.unpack("<Q", self._at(seek_at - 8, 8))
        raw = zstandard.ZstdDecompressor().decompress(table, max_output_size=max(1, count * _DOC.size))
        self.docs = list(_DOC.iter_unpack(raw))
        self.cached = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def frame(self, k: int) -> bytes:
        """The plain bytes of frame k, whose checksum must hold."""
        if self.cached[0] != k:
            packed, plain, check = (int(x) for x in self.frames[k])
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.packed_at[k]), packed), max_output_size=plain)
            if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.cached = (k, raw)
        return self.cached[1]

    def ids(self, doc: int) -> np.ndarray:
        """The ids of the doc-th document; only the frames that hold it are decompressed."""
        _, first, n, _ = self.docs[doc]
        lo, hi = 4 * first, 4 * (first + n)
        k = int(np.searchsorted(self.plain_at, lo, "right")) - 1
        parts = []
        while lo < hi:
            at = int(self.plain_at[k])
            part = self.frame(k)[lo - at : hi - at]
            parts.append(part)
            lo += len(part)
            k += 1
        return np.frombuffer(b"".join(parts), "<u4")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI on the file system that Spark takes it to be on, as every executor must."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _plan_bytes(docs: DataFrame) -> int:
    """The optimizer's estimate of the input's size, from files' sizes where it is a scan; 0 where it knows none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    files: int | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Writes the files and returns, as a written-out table in memory of one row a file, (file, path, docs, tokens).

    folder is a URI or a path of Spark's default file system. There are as many files as shuffle partitions, or as
    the plan's estimated size needs at FILE_BYTES of input each; files, if given, is their number.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, _plan_bytes(docs) // FILE_BYTES))  # joins may be estimated far too large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encode, writer = None, None
        store, base = pa.fs.FileSystem.from_uri(folder)
        n = 0
        for b in batches:
            encode = encode or word_encoder(tokenizer)
            if writer is None and b.num_rows:
                store.create_dir(base, recursive=True)
                draft = f"{base}/.draft-{context.partitionId()}-{context.taskAttemptId()}"
                stream = store.open_output_stream(draft)
                writer = FileWriter(stream)
            doc_ids = iter(b.column(0).to_pylist())
            for ids, ends in encode.flat(b.column(1), end_id):
                start = 0
                for end in ends.tolist():
                    writer.add(next(doc_ids), ids[start:end])
                    start = end
                    n += 1
        if writer is not None:
            writer.close()
            stream.close()
            name = f"tokens-{context.partitionId():06d}.zst"
            store.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([context.partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "docs": pa.array([n], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())}
            )

    # rows of one id are dealt by their texts' hashes, and equal ones by where they come from, so a hot id is many files
    key, hashed = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(files, key, hashed, F.spark_partition_id())
        .sortWithinPartitions(key, hashed, "text")
        .mapInArrow(run, "file int, path string, docs long, tokens long")
        .collect()  # a row for each file
    )
    rows = sorted(rows, key=lambda r: r["file"])
    firsts = np.concatenate([[0], np.cumsum([r["tokens"] for r in rows])]).astype(int)
    listed = [(*r, int(f)) for r, f in zip(rows, firsts, strict=False)]
    return spark.createDataFrame(listed, "file int, path string, docs long, tokens long, first long")


def read(listing: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of the files that write() lists, or of the wanted ids.

    start counts the ids of all documents before it, over all files.
    """
    wanted_set = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, base = pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(base) as stream:
                    reader = FileReader(stream, stream.size())
                    rows, held = [], 0
                    for k, (doc_id, at, n, null) in enumerate(reader.docs):
                        doc_id = None if null else doc_id
                        if wanted_set is None or doc_id in wanted_set:
                            rows.append((doc_id, first + at, n, reader.ids(k).tobytes()))
                            held += n
                        if held > 1 << 20 or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    files = listing.select("path", "first").repartition(max(1, listing.sparkSession.sparkContext.defaultParallelism))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
