"""Byte-level BPE encoding and decoding with a tokenizer file's vocabulary and merges.

Texts are split as the file's pre-tokenizer does. A short word's parts lie in a contiguous array beside the ranks
of adjacent parts: the least rank is scanned for, the boundary there is deleted, the two ranks beside it are
refreshed, until no pair has a rank. Words of one length are handled together, a row each: every round deletes
just one boundary a row, so the rows stay equally long. Words above SHORT bytes keep the ranks in a heap instead,
since scanning costs the square of the length.

Defined cases: a null or empty text has no ids and decodes to the empty text; the string of a special token in a
text is that token; ids that the vocabulary lacks decode to nothing, bytes that aren't UTF-8 to U+FFFD; repeated
rows each get their row; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.tokens import ChunkEncoder, gathered, le_bytes

#: Bytes of the longest word whose ranks are scanned.
SHORT = 48
#: Of byte-level vocabularies, fixed: how a text is split, and that printable bytes stand for themselves, the others for what follows 255.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
NONE = np.int32(2**31 - 1)


def _letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary's strings stands for."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """Rank of a pair of ids by open addressing; NONE for others. The pair of rank r makes id made[r]."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        self.made = made.astype(np.int32)
        keys = self._keys(pairs[:, 0], pairs[:, 1])
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 3)
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = self._place(keys[left], self.probes)
            free = self.ranks[at] == NONE
            first = np.unique(np.where(free, at, -1), return_index=True)
            take = first[1][first[0] >= 0]
            self.keys[at[take]], self.ranks[at[take]] = keys[left[take]], left[take]
            left = np.delete(left, take)
            self.probes += 1

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift) + np.uint64(k)) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._keys(a, b)
        out = np.full(len(keys), NONE)
        left = np.arange(len(keys))
        for k in range(self.probes):
            at = self._place(keys[left], k)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit & (self.ranks[at] != NONE)]
            if not len(left):
                break
        return out


class Codec:
    """What a task needs of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.bytes_of = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.single[b] = vocab[c]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.merges = Merges(pairs, np.array([vocab[a + b] for a, b in merges]))
        self.words = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def encoder(self) -> ChunkEncoder:
        return ChunkEncoder(self.chunks, self.of_chunks)

    def chunks(self, text: str) -> list[str]:
        """Parts at which no word reaches over: a space before what isn't white space begins a word."""
        if self.cut is not None and any(s in text for s in self.special):
            parts = [p for p in self.cut.split(text) if p]
            return [c for p in parts for c in ([p] if p in self.special else self.chunks(p))]
        parts = _SPACE.split(text) if _ODD.search(text) else text.split(" ")
        return [*parts[:1], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after another, and each chunk's number of them."""
        places: dict[str, int] = {}
        place = places.setdefault
        words = [[c] if c in self.special else self.words(c) for c in chunks]
        at = np.array([place(w, len(places)) for ws in words for w in ws], np.int64)
        ids, ends = self.of_words(list(places))
        starts = np.concatenate([[0], ends[:-1]])
        sizes = (ends - starts)[at]
        into = np.cumsum(sizes)
        flat = ids[np.repeat(starts[at] - (into - sizes), sizes) + np.arange(int(into[-1]) if len(into) else 0)]
        ends = np.concatenate([[0], into])[np.cumsum([len(ws) for ws in words])].astype(np.int64)
        return flat, np.diff(ends, prepend=0)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and where each word's end."""
        raw = [w.encode("utf-8") for w in words]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (places of words, a row of ids for each)
        by_size: dict[int, list[int]] = {}
        for k, (w, b) in enumerate(zip(words, raw, strict=True)):
            if w in self.special:
                found.append((np.array([k]), np.array([[self.special[w]]])))
            elif len(b) > SHORT:
                found.append((np.array([k]), np.array([self.long_word(b)])))
            else:
                by_size.setdefault(len(b), []).append(k)
        for n, ks in by_size.items():
            block = np.frombuffer(b"".join([raw[k] for k in ks]), np.uint8).reshape(len(ks), n)
            found += self.short_words(np.array(ks), self.single[block])
        sizes = np.zeros(len(words), np.int64)
        for ks, rows in found:
            sizes[ks] = rows.shape[1]
        ends = np.cumsum(sizes)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for ks, rows in found:
            ids[(ends[ks] - rows.shape[1])[:, None] + np.arange(rows.shape[1])] = rows
        return ids, ends

    def short_words(self, ks: np.ndarray, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """parts: a row for each word, first of its bytes' ids. Rows leave when none of their pairs has a rank."""
        done = []
        m, n = parts.shape
        ranks = self.merges.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(m, n - 1)
        while parts.shape[1] > 1:
            j = ranks.argmin(axis=1)
            least = ranks[np.arange(len(j)), j]
            ended = least == NONE
            if ended.any():
                done.append((ks[ended], parts[ended]))
                ks, parts, ranks, j, least = ks[~ended], parts[~ended], ranks[~ended], j[~ended], least[~ended]
            if not len(ks):
                return done
            row, n = np.arange(len(ks)), parts.shape[1]
            parts[row, j] = self.merges.made[least]
            parts = parts[np.arange(n) != (j + 1)[:, None]].reshape(len(ks), n - 1)
            ranks = ranks[np.arange(n - 1) != j[:, None]].reshape(len(ks), n - 2)
            r = row[j > 0]
            ranks[r, j[r] - 1] = self.merges.rank(parts[r, j[r] - 1], parts[r, j[r]])
            r = row[j < n - 2]
            ranks[r, j[r]] = self.merges.rank(parts[r, j[r]], parts[r, j[r] + 1])
        done.append((ks, parts))
        return done

    def long_word(self, raw: bytes) -> list[int]:
        """The same merges, least rank first and leftmost of equals, with a heap and linked parts."""
        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.merges.rank(np.array([a]), np.array([b]))[0])
            return known[a, b]

        first = self.merges.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else -1
            if j < 0 or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.merges.made[r]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (s := rank(ids[i], ids[right[i]])) != NONE:
                    heapq.heappush(heap, (s, i))
            if left[i] >= 0 and (s := rank(ids[left[i]], ids[i])) != NONE:
                heapq.heappush(heap, (s, left[i]))
        return [i for i in ids if i >= 0]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's start; ids beyond have none."""
        sizes = np.zeros(max(self.bytes_of) + 2, np.int64)
        sizes[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        flat = b"".join([self.bytes_of.get(i, b"") for i in range(len(sizes))])
        return np.frombuffer(flat, np.uint8), np.append(0, np.cumsum(sizes))

    def decode(self, ids: np.ndarray) -> str:
        flat, starts = self.table
        at = np.minimum(np.asarray(ids, np.int64), len(starts) - 2)
        return gathered(flat, starts[at], starts[at + 1] - starts[at])[0].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    return Codec(path)


_SPACE, _ODD = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)")


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(doc_id, ids), ids as little-endian unsigned 32-bit integers; decoded adds their text, from the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for flat, ends in codec.encoder.flat(batch.column(1)):
                parts = np.split(flat, ends[:-1])
                columns = [doc_ids.slice(at, len(parts)), pa.array([le_bytes(x) for x in parts], pa.binary())]
                if decoded:
                    columns.append(pa.array([codec.decode(x) for x in parts], pa.string()))
                at += len(parts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
