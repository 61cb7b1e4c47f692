"""Embedders as steps of a plan: against numpy, and as a store's."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_embeddings import tensor_file
from wrenfold.__main__ import main
from wrenfold.operators import embedders
from wrenfold.operators.embedders import ColumnEmbedder, TableEmbedder, loaded
from wrenfold.operators.store import KnowledgeStore

WORDS = {"disk": 0, "full": 1, "storage": 2, "exhausted": 3, "lock": 4, "timeout": 5, "?": 6, "beyond": 9}
MATRIX = np.array([[1, 0.1, 0], [0.8, 0, 0.1], [1, 0, 0.1], [0.9, 0.1, 0], [0, 1, 0], [0, 0.9, 0.2], [0, 0, 0]], "<f4")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path_factory.mktemp("model")
    model = Tokenizer(models.WordLevel(WORDS, unk_token="?"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.enable_truncation(2)  # what a file says of lengths is left aside
    model.save(str(folder / "t.json"))
    return tensor_file(folder / "m.bin", MATRIX), str(folder / "t.json")


def by_hand(text, unit):
    ids = [WORDS.get(w, 6) for w in (text or "").split()]
    rows = [MATRIX[i].astype(float) for i in ids if i < len(MATRIX)]
    if not rows:
        return np.zeros(3)
    total = sum(rows)
    if not unit:
        return total / len(rows)
    size = np.linalg.norm(total)
    return total / size if size else total


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("unit", [True, False])
def test_against_numpy(spark, files, unit, broadcast):
    model = TableEmbedder(embedders.read_table(spark, files[0]), embedders.tokenizer_ids(spark, files[1]), unit, broadcast)
    assert model.small == bool(broadcast)
    texts = ["disk full", None, "", "beyond", "unknown", "lock timeout lock lock", "disk full", "disk beyond", "full " * 20_000] + ["lock"] * 500
    rows = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "token long, t string, vector string").repartition(3)
    out = model.add(rows, F.col("t"))
    assert out.columns == ["token", "t", "vector", "embedding"]
    got = {r["token"]: r["embedding"] for r in out.collect()}
    assert len(got) == len(texts) and out.count() == len(texts)
    assert all(np.allclose(got[k], by_hand(t, unit), atol=1e-6) for k, t in enumerate(texts))
    again = model.add(out, F.lit("lock"))  # a column of that name is replaced
    assert again.columns == ["token", "t", "vector", "embedding"] and np.allclose(again.first()["embedding"], by_hand("lock", unit), atol=1e-6)
    assert model.add(rows.limit(0), F.col("t")).count() == 0


def test_distinct_texts_move_once(spark, files):
    model = TableEmbedder(embedders.read_table(spark, files[0]), lambda t: F.transform(F.split(t, " "), F.length).cast("array<long>"))
    rows = model.add(spark.createDataFrame([(1, "a bb")], "id long, t string"), F.col("t"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert 1 <= len(moved) <= 2 and all("_embed_key" in line for line in moved), plan


def test_refused_tables(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "token long, vector array<float>")
    for bad in (rows, rows.limit(0)):
        with pytest.raises(ValueError, match="width"):
            TableEmbedder(bad, lambda t: F.array(F.lit(0)))


def test_store_on_a_tensor_file(spark, files, tmp_path):
    kb = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=loaded(spark, *files))
    saves = [(k, title, "workflow", "c", "d", "v", [], "a", None, None) for k, title in enumerate(["disk full", "lock timeout", "none of these"])]
    schema = "seq long, title string, kind string, context string, content string, verification string, tags array<string>, project_scope string, entry_id string, dedup_key string"
    assert {r["reason"] for r in kb.save(spark.createDataFrame(saves, schema)).collect()} <= {None}
    hits = kb.search("storage exhausted", 3).orderBy("place").collect()  # shares no word with any entry
    assert hits[0]["title"] == "disk full" and hits[0]["keyword_rank"] is None and hits[0]["semantic_score"] > 0.9
    held = {r["title"]: r["embedding"] for r in kb.current(vectors=True).collect()}
    assert np.allclose(held["lock timeout"], by_hand("lock timeout", True), atol=1e-6)
    kb.embed = ColumnEmbedder(lambda t: F.array(F.length(t).cast("float"), F.lit(0.0).cast("float"), F.lit(1.0).cast("float")))
    kb.reindex()
    assert all(r["embedding"][2] == 1.0 for r in kb.current(vectors=True).collect())


def test_without_a_model(spark, files, tmp_path, caplog, capsys):
    assert loaded(spark, str(tmp_path / "none.bin"), files[1]) is None and "keywords alone" in caplog.text
    assert loaded(spark, files[0], str(tmp_path / "none.json")) is None
    root = f"file://{tmp_path}/kb"
    saves = tmp_path / "saves.json"
    saves.write_text('{"seq": 0, "title": "disk full", "kind": "workflow", "context": "c", "content": "d", "verification": "v", "tags": []}\n')
    assert main(["--root", root, "--tensors", str(tmp_path / "none.bin"), "--tokenizer", files[1], "save", str(saves)]) in (0, None)
    main(["--root", root, "--tensors", files[0], "--tokenizer", files[1], "search", "disk"])
    assert "disk full" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--root", root, "--tensors", files[0], "stats"])
