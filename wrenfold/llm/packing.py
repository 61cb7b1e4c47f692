"""Packing of documents into sequences of a fixed length: bounded-space online best fit.

A task reads its documents one after another and keeps a fixed number of open windows. A document's whole
sequences' worth is cut off first. The rest goes into the open window that it fits best, or into a new one. When
none fits and no more may be opened, the fullest is filled with the head of the document and emitted, and what
is left of the document is placed again; so an emitted window has no padding. What the open windows of a task
hold at its end are leftovers. Their pieces are merged afterwards: leftovers of MERGED tasks at a time are joined,
fullest first, and cut at the sequence length, which leaves at most one padded sequence for each such group.

The tasks' pieces are written to the shared folder once, so leftovers and full sequences come from the same
attempt of a task, whichever executors are lost. Ids that the caller does not ask for are written for leftovers
alone; a merging task holds MERGED x windows x size ids at most, 34 MB at 64 windows of 2048.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null;
texts of any length are cut as needed; windows of
equal room are taken in the order of their opening; an empty table gives no pieces; other columns are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import written
from wrenfold.llm.tokens import le_bytes, word_encoder

#: Tasks whose leftovers are merged together.
MERGED = 64

PIECE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
_STAGED = f"{PIECE}, task int, leftover boolean"


class Packer:
    """The open windows of one task. put() places a document; emit(window, pieces) gets each window that is full."""

    def __init__(self, size: int, windows: int, emit):
        self.size, self.windows, self.emit = size, windows, emit
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def _open(self) -> int:
        self.next += 1
        self.held[self.next] = []
        return self.next

    def _place(self, window: int, room: int, doc: object, start: int, length: int) -> None:
        self.held[window].append((doc, start, length, self.size - room))
        if room > length:
            insort(self.room, (room - length, window))
        else:
            self.emit(window, self.held.pop(window))

    def put(self, doc: object, total: int) -> None:
        start = 0
        while total - start >= self.size:
            self._place(self._open(), self.size, doc, start, self.size)
            start += self.size
        while start < total:
            rest = total - start
            k = bisect_left(self.room, (rest, 0))
            if k < len(self.room):
                room, window = self.room.pop(k)
            elif len(self.room) < self.windows:
                room, window = self.size, self._open()
            else:
                room, window = self.room.pop(0)  # the fullest
            length = min(room, rest)
            self._place(window, room, doc, start, length)
            start += length


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    windows: int = 64,
    text_col: str = "text",
    id_col: str = "doc_id",
    with_ids: bool = True,
) -> DataFrame:
    """PIECE rows: ids as little-endian unsigned 32-bit integers and their CRC-32, offset the piece's place in its sequence.

    with_ids False leaves the column ids out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        task = TaskContext.get().partitionId()
        done: list[tuple] = []

        def rows(window: int, pieces: list, left: bool) -> None:
            sequence = (task << 33) + 2 * window
            for (doc_id, raw), start, length, offset in pieces:
                ids = raw[4 * start : 4 * (start + length)]
                done.append((doc_id, start, length, ids if left or with_ids else None, zlib.crc32(ids), len(raw) // 4, sequence, offset, task, left))

        def batch() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done.clear()
            return out

        packer = Packer(size, windows, lambda window, pieces: rows(window, pieces, False))
        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for ids, ends in encode.flat(b.column(1), end_id):
                start = 0
                for end in ends.tolist():
                    packer.put((next(doc_ids), le_bytes(ids[start:end])), end - start)
                    start = end
                    if len(done) >= 2000:
                        yield batch()
        for window, pieces in packer.held.items():
            rows(window, pieces, True)
        yield batch()

    schema = _schema(_STAGED)
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _STAGED)
    placed = written(placed, "pieces", ("leftover",))
    columns = [c for c in _schema(PIECE).names if with_ids or c != "ids"]
    full = placed.where("not leftover").select(*columns)
    left = placed.where("leftover").withColumn("group", F.floor(F.col("task") / MERGED))
    return full.unionByName(left.groupBy("group").applyInArrow(_merger(size), PIECE).select(*columns))


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, fields.split(", "))])


def _merger(size: int):
    """Joins the leftover windows of a group, fullest first, and cuts them at the sequence length."""

    def run(table: pa.Table) -> pa.Table:
        sequences, lengths, offsets = (table[c].to_numpy() for c in ("sequence_id", "length", "offset"))
        window = np.unique(sequences, return_inverse=True)[1]
        held = np.bincount(window, weights=lengths)[window]
        order = np.lexsort((offsets, sequences, -held))
        doc_ids, starts, ids, totals = (table[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        group, at, out = table["group"][0].as_py(), 0, []
        for k in order.tolist():
            done, length = 0, len(ids[k]) // 4
            while done < length:
                take = min(length - done, size - at % size)
                # odd numbers: those of the tasks' own sequences are even
                sequence = ((group * MERGED) << 33) + 2 * (at // size) + 1
                part = ids[k][4 * done : 4 * (done + take)]
                out.append((doc_ids[k], starts[k] + done, take, part, zlib.crc32(part), totals[k], sequence, at % size))
                done += take
                at += take
        schema = _schema(PIECE)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run
