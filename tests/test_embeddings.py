"""Tensor files and pooled embeddings against numpy."""

import json
import struct

import numpy as np
import pytest

from wrenfold.sources import embeddings


def tensor_file(path, array, name="embeddings", dtype="F32", shape=None):
    raw = array.tobytes()
    header = json.dumps({name: {"dtype": dtype, "shape": shape or list(array.shape), "data_offsets": [0, len(raw)]}}).encode()
    path.write_bytes(struct.pack("<Q", len(header)) + header + raw)
    return str(path)


@pytest.mark.parametrize(("dtype", "kind", "name"), [("F32", "<f4", "embeddings"), ("F16", "<f2", "0"), ("I8", "i1", "0")])
def test_table(spark, tmp_path, dtype, kind, name):
    m = (np.random.default_rng(0).normal(size=(5000, 3)) * 20).astype(kind)
    rows = embeddings.read_table(spark, tensor_file(tmp_path / "m.bin", m, name, dtype)).orderBy("token").collect()
    assert [r["token"] for r in rows] == list(range(5000))
    assert np.array_equal(np.array([r["vector"] for r in rows], np.float32), m.astype(np.float32))


@pytest.mark.parametrize("bad", [{"name": "other"}, {"dtype": "F64"}, {"shape": [4, 4]}, {"shape": [12]}])
def test_refused(spark, tmp_path, bad):
    with pytest.raises(Exception, match="tensor"):
        embeddings.read_table(spark, tensor_file(tmp_path / "m.bin", np.zeros((4, 3), "<f4"), **bad)).collect()


def test_embedded(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"a": 0, "b": 1, "far": 9, "?": 2}, unk_token="?"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.save(str(tmp_path / "t.json"))
    m = np.array([[1, 2], [3, -1], [0, 0]], "<f4")
    table = embeddings.read_table(spark, tensor_file(tmp_path / "m.bin", m))
    texts = spark.createDataFrame([("1", "a a b far"), ("2", ""), ("3", "far")], "id string, text string")
    for unit in (True, False):
        got = {r["id"]: r["vector"] for r in embeddings.embedded(texts, table, str(tmp_path / "t.json"), unit=unit).collect()}
        want = m[0] * 2 + m[1]
        want = want / np.linalg.norm(want) if unit else want / 3
        assert got.keys() == {"1"} and np.allclose(got["1"], want)
