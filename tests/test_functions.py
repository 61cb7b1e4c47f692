"""Text rules, vectors and rendering on hand-made rows."""

from pyspark.sql import functions as F

from wrenfold.functions import redaction, render, textops, vectors
from wrenfold.operators import similarity
from wrenfold.sources import records


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(column.alias("x")).first()["x"]


def test_redaction(spark):
    got = one(spark, redaction.redact(F.col("t")), t="postgres://u:pw@h and sk-" + "a" * 24)
    assert got["clean"] == "postgres://u:[REDACTED]@h and [REDACTED_OPENAI_KEY]" and got["n"] == 2
    # a later rule sees the marker of an earlier one
    assert one(spark, redaction.redact(F.col("t")), t="api_key: sk-" + "a" * 24)["n"] == 2
    assert one(spark, redaction.redact(F.col("t")), t="nothing")["n"] == 0


def test_keys(spark):
    key = textops.dedup_key(F.col("s"), F.col("t"))
    a = one(spark, key, s=" ", t="Error at /tmp/x1/y: port :8080 — Übergröße!")
    assert a == "global:error-at-port-übergröße"
    assert one(spark, key, s="A b", t="2024-01-02") == "A b:2024-01-02"
    assert one(spark, key, s=None, t="---") == "global:"


def test_bounds_and_tags(spark):
    assert one(spark, textops.bounded(F.col("t"), 4), t="  éé  ")["value"] == "éé"
    assert one(spark, textops.bounded(F.col("t"), 3), t="éé")["reason"] == "too long: 4"
    assert one(spark, textops.bounded(F.col("t"), 3), t=None)["reason"] == "empty"
    tags = F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("B "))
    assert one(spark, textops.clean_tags(tags))["value"] == ["a", "b"]
    assert one(spark, textops.clean_tags(F.array(*[F.lit("x")] * 33)))["reason"] == "too many tags"
    assert one(spark, textops.clean_tags(F.array(F.lit("x" * 65))))["reason"] == "tag too long"
    assert one(spark, textops.union_tags(F.array(F.lit("DB"), F.lit("x")), F.array(F.lit("db"), F.lit("Y")))) == ["DB", "x", "Y"]


def test_head_bytes(spark):
    for text in ("é" * 10, "a" + "é" * 10, "aé中😀" * 4, "", "abc"):
        for most in range(1, 12):
            want = text.encode()[:most].decode(errors="ignore")
            assert one(spark, textops.head_bytes(F.col("t"), most), t=text) == want, (text, most)


def test_verification(spark):
    m = textops.merge_verification(F.col("a"), F.col("b"))
    assert one(spark, m, a="x", b=" x ") == "x" and one(spark, m, a="x y", b="y") == "x y"
    assert one(spark, m, a=" ", b="n") == "n" and one(spark, m, a="x", b="") == "x"
    assert one(spark, m, a="x", b="n") == "x\n---\nAdditional verification: n"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.dot(v(1, 2, 3), v(4, 5))) == 14.0
    assert one(spark, vectors.cosine(v(1, 0), v(0, 1))) == 0.0 and one(spark, vectors.cosine(v(2, 2), v(1, 1))) > 1 - 1e-12
    assert one(spark, vectors.cosine(v(0, 0), v(1, 1))) == 0.0 and one(spark, vectors.cosine(v(1), v(1, 1))) == 0.0
    assert one(spark, vectors.normalise(v(0, 0))) == [0.0, 0.0] and one(spark, vectors.normalise(v(3, 4))) == [0.6, 0.8]
    rows = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    back = rows.select("v", vectors.from_bytes(vectors.to_bytes("v")).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in back)


def test_vector_top(spark):
    rows = spark.createDataFrame(
        [("a", "s", ["x"], [1.0, 0.0]), ("b", "s", [], [0.6, 0.8]), ("c", None, ["X", "y"], [0.9, 0.1]), ("d", "s", [], []), ("e", "s", [], [0.1, 0.9])],
        "id string, project_scope string, tags array<string>, embedding array<float>",
    )
    ids = lambda **k: [r["id"] for r in similarity.vector_top(rows, [1.0, 0.0], 10, **k).collect()]
    assert ids() == ["a", "c", "b"] and ids(scope="s") == ["a", "b"] and ids(tags=["x"]) == ["a", "c"]
    assert similarity.vector_top(rows, [], 10).count() == 0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "t", "odd", "c", "é\n", "v", ["a"], None, None, None, None), ("2", "u", "workflow", "c", "d", "v", [], "s", None, None, "k")], records.RECORD
    )
    records.export_lines(rows, str(tmp_path / "lines.jsonl"))
    back = records.imported(records.read_json(spark, str(tmp_path / "lines.jsonl")))
    assert {(r["id"], r["kind"], r["content"], r["dedup_key"]) for r in back.collect()} == {("1", "workflow", "é\n", None), ("2", "workflow", "d", "k")}
    records.export_array(rows, str(tmp_path / "array"), scope="s")
    assert [r["id"] for r in records.read_json(spark, str(tmp_path / "array")).collect()] == ["2"]
    good = records.string_array(F.col("t"))
    assert one(spark, good, t='["a", "b,\\"c"]')["value"] == ["a", 'b,"c'] and one(spark, good, t=None)["value"] == []
    assert one(spark, good, t="[1]")["reason"] and one(spark, good, t="null")["reason"] and one(spark, good, t='{"a": 1}')["reason"]


def test_rendering(spark):
    r = {"id": "1", "title": "T", "kind": "workflow", "project_scope": None, "context": " c ", "content": "x", "verification": "v"}
    cols = {k: F.lit(v).cast("string") for k, v in r.items()} | {"tags": F.array().cast("array<string>")}
    text = one(spark, render.full(F.lit(1), cols, F.lit(2), F.lit(None).cast("double")))
    assert "`global` | **Tags:** none" in text and "- **Match Signals:** BM25 #2\n" in text and "  > c\n" in text
    assert one(spark, render.found_line(F.lit(0), F.lit("q"), F.lit("x"))) == 'No knowledge entries found matching query: "q".'
    assert "1 Knowledge entry for" in one(spark, render.found_line(F.lit(1), F.lit("q"), F.lit("x")))
    assert one(spark, render.deleted(F.lit("7"), F.lit(True))) == "Successfully deleted knowledge entry `7`."
    assert "Redacted 2 credentials" in one(spark, render.saved(cols, F.lit(False), F.lit(2)))
