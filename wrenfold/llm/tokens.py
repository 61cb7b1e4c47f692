"""Token ids of whole texts by a tokenizer file of the tokenizers library, a word at a time.

Where a tokenizer splits texts at white space before its merges, a text's ids are those of its chunks one after
another. So a task encodes each distinct chunk once, many at a time, and keeps what it has met; texts are then
gathered from the chunks' ids with numpy. When the store of chunks is full it forgets those met last, so memory is
bounded; a Python worker keeps it from task to task. Texts are taken together up to a number of bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks that a task keeps.
KEPT = 500_000
#: Bytes of the texts that are encoded together, about: a text alone may have more.
GROUP_BYTES = 1 << 23


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """The texts in slices of at most that many bytes, or of one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of other than the six ASCII blanks in all texts one after another, and where each text's end."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, ends = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    ends = ends[1:] - ends[0]
    full = np.asarray(pc.binary_length(words).to_numpy(zero_copy_only=False)) > 0
    if not full.all():  # a blank at a text's end makes an empty part there
        words, ends = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]
    return words, ends


def gathered(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of source one after another, and where each ends."""
    into = np.cumsum(sizes)
    take = np.repeat(starts - (into - sizes), sizes)
    take += np.arange(len(take))
    return source[take], into


class ChunkEncoder:
    """Ids of texts from the ids of their chunks.

    split: a text's chunks; encode: the ids of a list of chunks one after another, and each chunk's number of them.
    """

    def __init__(self, split: Callable[[str], list], encode: Callable[[list], tuple[np.ndarray, np.ndarray]], kept: int = KEPT, group_bytes: int = GROUP_BYTES // 8):
        self.split, self.encode, self.kept, self.group_bytes = split, encode, kept, group_bytes
        self.places: dict = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _drop(self) -> None:
        """Keeps the half that was met first, in which the frequent chunks are."""
        half = self.kept // 2
        self.places = dict(islice(self.places.items(), half))
        self.starts = self.starts[: half + 1].copy()
        self.ids = self.ids[: int(self.starts[-1])].copy()

    def _add(self, chunks: list) -> None:
        found, sizes = self.encode(chunks)
        end = int(self.starts[-1])
        need = end + int(sizes.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.empty(max(need, 2 * len(self.ids)) - end, np.uint32)])
        if need > end:
            self.ids[end:need] = found
        first = len(self.starts) - 1
        self.places.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, end + np.cumsum(sizes)])

    def find(self, chunks: list) -> np.ndarray:
        """The places of the chunks in the store, to which those that it lacks are added."""
        if len(self.places) > self.kept:
            self._drop()
        at = np.fromiter(map(self.places.get, chunks, repeat(-1)), np.int64, len(chunks))
        out = np.flatnonzero(at < 0).tolist()
        if out:
            missing = [chunks[k] for k in out]
            self._add(list(dict.fromkeys(missing)))
            at[out] = [self.places[c] for c in missing]
        return at

    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the chunks at those places start, and their numbers."""
        return self.starts[at], self.starts[at + 1] - self.starts[at]

    def chunks_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, where in it each chunk's start and their number, and where each text's chunks end."""
        chunks: list = []
        ends = []
        for text in texts:
            chunks += self.split(text.as_py()) if text.is_valid else []
            ends.append(len(chunks))
        starts, sizes = self.spans(self.find(chunks))
        return self.ids, starts, sizes, np.array(ends, np.int64)

    def flat(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of the texts: their ids one after another, and where each text's end; end_id follows each text."""
        for part in groups(texts, self.group_bytes):
            source, starts, sizes, ends = self.chunks_of(part)
            ids, into = gathered(source, starts, sizes)
            ends = np.concatenate([[0], into])[ends].astype(np.int64)
            if end_id is not None:
                ends = ends + np.arange(1, len(ends) + 1)
                whole, own = np.empty(len(ids) + len(ends), np.uint32), np.ones(len(ids) + len(ends), bool)
                own[ends - 1] = False
                whole[own], whole[ends - 1] = ids, end_id
                ids = whole
            yield ids, ends

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text, a null text's none."""
        for ids, ends in self.flat(pa.array(list(texts), pa.string())):
            yield from np.split(ids, ends[:-1]) if len(ends) else ()


class WordEncoder(ChunkEncoder):
    """The same with words as chunks.

    prepare may change the letters of texts before they are split; cut gives, of distinct words, the parts whose ids
    follow one another, and each word's number of them. The store holds parts.
    """

    def __init__(self, prepare: Callable[[pa.Array], pa.Array], cut: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], encode: Callable[[list], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        super().__init__(str.split, encode, kept, GROUP_BYTES)
        self.prepare, self.cut = prepare, cut

    def chunks_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, ends = split_words(self.prepare(pc.fill_null(texts, "")))
        words = words.dictionary_encode()
        parts, counts = self.cut(words.dictionary)
        parts = parts.dictionary_encode()
        at = self.find(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, into = gathered(self.ids, *self.spans(at[parts.indices.to_numpy()]))
        word_ends = np.concatenate([[0], into])[np.cumsum(counts)].astype(np.int64)
        codes = words.indices.to_numpy()
        sizes = np.diff(word_ends, prepend=0)
        return ids, (word_ends - sizes)[codes], sizes[codes], ends


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """For files whose pre-tokenizer drops white space, such as word_bpe_49k.json.

    ASCII blanks bound chunks: neither normalizer nor splits nor merges reach across them. A special token's
    string in a text is that token, as the library has it; no such string holds a blank. Where the tokenizer makes
    letters small, A-Z are made small beforehand, so fewer chunks differ; not in texts with combining marks, which
    join small letters that they do not join when large, nor with a special token.
    """
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    special = model.get_added_tokens_decoder()
    mark, mark_id = next(((t.content, i) for i, t in sorted(special.items())), (None, -1))

    lowers = '"Lowercase"' in (model.normalizer.__getstate__().decode() if model.normalizer else "")
    strings = [t.content for t in special.values()]

    def prepare(texts: pa.Array) -> pa.Array:
        if not lowers:
            return texts
        held = np.zeros(len(texts), bool)
        other = np.flatnonzero(~np.asarray(pc.string_is_ascii(texts).to_numpy(zero_copy_only=False), bool))
        if len(other):
            held[other] = pc.match_substring_regex(texts.take(pa.array(other)), r"\p{M}").to_numpy(zero_copy_only=False)
        for s in strings:
            held |= np.asarray(pc.match_substring(texts, s).to_numpy(zero_copy_only=False), bool)
        small = pc.ascii_lower(texts)
        return pc.if_else(pa.array(held), texts, small) if held.any() else small

    def by_library(chunks: list[str]) -> list[list[int]]:
        text = mark and mark.join(chunks)
        if text is None or text.count(mark) != len(chunks) - 1:  # a chunk holds the mark
            return [e.ids for e in model.encode_batch_fast(chunks, add_special_tokens=False)]
        # a special token parts texts as nothing else does
        ids = np.asarray(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(ids == mark_id)
        return [x.tolist() for x in np.split(np.delete(ids, at), at - np.arange(len(at)))]

    tokenize = model.model.tokenize

    def merged(word: str) -> list[int]:
        return [t.id for t in tokenize(word if word.isascii() else "".join([_LETTERS[c] for c in word]))]

    plain = _drops_blanks(model) and not any(s.isalpha() for s in strings)

    def cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts the stops around a word of letters from it, which the split does too; a special token's string stays."""
        n = len(words)
        size, after = pc.binary_length(words).to_numpy(), pc.binary_length(pc.ascii_ltrim(words, _STOPS)).to_numpy()
        bodies = pc.ascii_trim(words, _STOPS)
        body = pc.binary_length(bodies).to_numpy()
        # Latin letters but the one whose small form ends in a combining mark
        latin = pc.and_(pc.utf8_is_alpha(bodies), pc.match_substring_regex(bodies, r"^[a-z\x{AA}-\x{12F}\x{131}-\x{24F}]+$"))
        whole = ~np.asarray(latin.to_numpy(zero_copy_only=False), bool) | (not plain)
        for s in strings:
            whole |= np.asarray(pc.match_substring(words, s).to_numpy(zero_copy_only=False), bool)
        bounds = np.empty((n, 3), np.int32)  # where the stops before, the body and the stops behind start
        bounds[:, 0] = np.cumsum(size) - size
        bounds[:, 1] = bounds[:, 0] + np.where(whole, 0, size - after)
        bounds[:, 2] = bounds[:, 1] + np.where(whole, size, body)
        bounds = np.append(bounds.ravel(), np.int32(size.sum()))
        data = pa.concat_arrays([words]).buffers()[2] if words.offset else words.buffers()[2]
        parts = pa.StringArray.from_buffers(3 * n, pa.py_buffer(bounds), data or pa.py_buffer(b""))
        full = np.diff(bounds) > 0
        return parts.filter(pa.array(full)), full.reshape(n, 3).sum(axis=1)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        sizes, order, rest = [], [], []
        for k, text in enumerate(texts):
            # a small Latin word goes to the merges without more ado
            if plain and text.isalpha() and text.islower() and (text.isascii() or max(text) < "\u0250"):
                ids = merged(text)
                flat += ids
                order.append(k)
                sizes.append(len(ids))
            else:
                rest.append(k)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for k, ids in zip(part, by_library([texts[k] for k in part]), strict=True):
                flat += ids
                order.append(k)
                sizes.append(len(ids))
        place, sizes = np.argsort(np.array(order, np.int64)), np.array(sizes, np.int64)
        starts, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        return gathered(np.array(flat, np.uint32), starts, sizes)[0], sizes

    return WordEncoder(prepare, cut, encode)


def _drops_blanks(model: Tokenizer) -> bool:
    """Whether the file makes letters small in NFC, splits into runs of letters, digits and runs of others, and maps bytes."""
    spec = json.loads(model.to_str())
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
    return steps == ["NFC", "Replace", "Lowercase"] and [p["pattern"].get("Regex") for p in splits] == [_SPLIT]


#: The split that word files make, ASCII marks but the apostrophe, and byte-level letters.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: How the vocabulary writes each Latin letter's bytes.
_LETTERS = {chr(c): "".join([_BYTES[b] for b in chr(c).encode("utf-8")]) for c in range(0x250)}


def le_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4", copy=False).tobytes()
