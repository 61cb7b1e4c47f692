"""Encoders against the tokenizers library, packing, token files: exact, on odd texts too."""

import random
import zlib

import numpy as np
import pyarrow.fs as fs
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wrenfold.llm import bpe, packing, queries, token_files, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "the", "Thon", "thon ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "é", "É", "ß", "'s", "'LL", "12", "!!", "<|endoftext|>", "<|startoftext|>",
        "<|endof", "😀", "\u0301", "\u0331", "H", "\x00", "ا", "中", "x" * 60, "ab" * 80, "***", "İ", "Σ", "ς", "ﬁ", "²", "_", "\u200d", "\r\n", ".", "(", "|"]


def odd_texts(n=2500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(n)] + ["a" * 5000, " " * 3000 + "x", "", None]


@pytest.mark.parametrize(("path", "make"), [(WORD, tokens.word_encoder), (BYTE, lambda p: bpe.codec_of(p).encoder)])
def test_ids_are_the_librarys(path, make):
    model, texts = Tokenizer.from_file(path), odd_texts()
    want = [e.ids for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in make(path).many(texts)] == want


def test_decoding_is_the_librarys():
    model, codec = Tokenizer.from_file(BYTE), bpe.codec_of(BYTE)
    rng = random.Random(2)
    for ids in [[rng.randrange(50300) for _ in range(9)] for _ in range(500)]:
        assert codec.decode(ids) == model.decode(ids, skip_special_tokens=False)


def test_full_store_forgets():
    encoder = tokens.ChunkEncoder(str.split, lambda chunks: (np.array([len(c) for c in chunks], np.uint32), np.ones(len(chunks), np.int64)), kept=10)
    texts = [" ".join("x" * (1 + (i * j) % 37) for j in range(9)) for i in range(50)]
    assert [x.tolist() for x in encoder.many(texts)] == [[len(w) for w in t.split()] for t in texts]
    assert len(encoder.places) <= 10 + 9 * len(texts)


def test_bpe_query(spark):
    import hashlib

    model = Tokenizer.from_file(BYTE)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, SMALL).collect():
        ids = model.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    rows = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert [r["decoded"] for r in bpe.decode(bpe.encode(rows, BYTE), BYTE).collect()] == ["", "", ""]


def check_pieces(pieces, ids_of, size):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids_of.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids_of[d]) and p["length"] > 0
            assert bytes(p["ids"]) == np.array(ids_of[d][at : at + p["length"]], "<u4").tobytes()
            at += p["length"]
        assert at == len(ids_of[d])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize(("size", "windows"), [(2048, 64), (64, 3), (1, 1)])
def test_packing(spark, size, windows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40") if size < 2048 else spark.read.parquet(f"{SMALL}/documents.parquet")
    model = Tokenizer.from_file(WORD)
    ids_of = {r["doc_id"]: [*model.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces = packing.pack(docs.repartition(3), WORD, size, 1, windows).collect()
    n = check_pieces(pieces, ids_of, size)
    total = sum(map(len, ids_of.values()))
    assert n <= -(-total // size) + 1  # at most one padded sequence


def test_packing_edges(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "w " * 9000, "x")], "doc_id long, text string, offset string")
    got = packing.pack(rows, WORD, 128).collect()
    assert sum(p["length"] for p in got) == 1 + 1 + 3 + 9001 and {p["doc_id"] for p in got} == {1, 2, None, 3}
    assert packing.pack(rows.limit(0), WORD).count() == 0


def test_crc_of_pieces(spark):
    got = queries.op6_packing(spark, SMALL)
    assert dict(got.dtypes)["ids_crc32"] == "bigint"
    model = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = {d: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    held = dict.fromkeys(ids, 0)
    for p in got.collect():
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
        held[p["doc_id"]] += p["length"]
    assert all(held[d] == len(ids[d]) for d in ids)


def test_ids_beyond_doubles_beside_null(spark):
    ids = [2**53 + 1, None, 2**53 + 3, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i, "a b " * k, "x") for k, i in enumerate(ids)], "doc_id long, text string, ids string")
    got = packing.pack(rows.repartition(3), WORD).collect()
    assert {p["doc_id"] for p in got} == set(ids)
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] for p in got)


def test_token_output_query(spark):
    """The whole table's ids in files and back, against the library."""
    model, at = Tokenizer.from_file(WORD), 0
    rows = {r["doc_id"]: r for r in queries.op10_token_output(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(rows[r["doc_id"]])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 50), " ".join(rng.choices(["a", "the", "thon", "é"], k=rng.randrange(30)))) for _ in range(60)] + [(None, "n"), (7, None), (8, "w " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    listing = token_files.write(df, f"file://{tmp_path}/out", WORD, end_id=2, files=4)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".draft")]
    got = sorted(token_files.read(listing).collect(), key=lambda r: r["start"])
    model = Tokenizer.from_file(WORD)
    hashed = lambda t: int(np.uint64(42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, at, len(ids))
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert {r["doc_id"] for r in token_files.read(listing, wanted=[8]).collect()} == {8}

    # a reader touches only the frames that it needs, and notices damage
    big = next(p["path"] for p in listing.collect() if token_files.read(spark.createDataFrame([p], listing.schema), [8]).count())
    store, path = fs.FileSystem.from_uri(big)
    raw = bytearray(store.open_input_file(path).read())
    import io

    reader = token_files.FileReader(io.BytesIO(bytes(raw)), len(raw))
    assert len(reader.frames) > 1
    seen = []
    frame = reader.frame
    reader.frame = lambda k: seen.append(k) or frame(k)
    reader.ids(0)
    assert seen == [0]
    raw[5] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017, PT011
        token_files.FileReader(io.BytesIO(bytes(raw)), len(raw)).frame(0)
    import zstandard

    plain = b"".join(reader.frame(k) for k in range(len(reader.frames)))
    assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(reader._at(0, int(reader.packed_at[1])))) == plain[: int(reader.plain_at[1])]


def test_a_hot_id_is_many_files(spark, tmp_path):
    rows = [(7, f"text {k} " * 5) for k in range(600)] + [(7, "the same")] * 600 + [(k, "other") for k in range(100)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, file string").repartition(6)
    listing = token_files.write(df, f"file://{tmp_path}/hot", WORD, end_id=2, files=8)
    assert listing.agg(F.max("docs")).first()[0] < 500
    got = token_files.read(listing).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(empty, f"file://{tmp_path}/none", WORD)).count() == 0
