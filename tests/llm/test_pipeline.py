"""The stages one after another against plain versions of what they decide, and the guard of the entry module."""

import numpy as np
import public_tokenizers
from conftest import SMALL
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_jaccard import brute_kept
from wrenfold.llm import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert kept.columns == COLUMNS
    bits = {r["doc_id"]: r["fail_bits"] for r in quality_rules.ledger(docs).collect()}
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows.keys() == {d for d, b in bits.items() if b & quality_rules.mask("v2") == 0}
    named = corpus_pipeline.language(spark, kept, SMALL)
    assert named.columns == COLUMNS
    ids = {r["doc_id"] for r in named.collect()}
    assert len(rows) - len(ids) <= 1  # all are prose in a learned language
    one = corpus_pipeline.near_duplicates(spark, named, SMALL)
    assert one.columns == COLUMNS
    order = sorted(ids)
    left = {order[k] for k in brute_kept([rows[d]["text"] for d in order])}
    assert {r["doc_id"] for r in one.collect()} == left
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {p["doc_id"] for p in packed} == left
    total = sum(len(model.encode(rows[d]["text"], add_special_tokens=False).ids) + 1 for d in left)
    assert sum(p["length"] for p in packed) == total
    assert sum(len(np.frombuffer(p["ids"], "<u4")) for p in packed) == total


def test_edges(spark):
    text = " ".join(f"word{i} thing{i}" for i in range(0, 120, 2))
    rows = spark.createDataFrame([(1, text, "en", "s", None, 1), (1, text, "en", "s", None, 1), (None, text, None, None, 3, 2), (4, None, "en", "s", 0, 3), (5, "", None, "s", 0, 3), (6, text + " x", "en", "t", 0, 3)], "doc_id long, text string, lang string, source string, n_chars long, doc int")
    out = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SMALL)
        assert out.columns == rows.columns
    assert [r["doc_id"] for r in out.collect()] == [1]
    empty = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_entry_lists_all():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
