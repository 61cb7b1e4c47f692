"""Steps that made more rows, or more work a row, than their result needs."""

from pyspark.sql import functions as F

from wrenfold.functions import textops, vectors


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_pooled_makes_one_row_a_text(spark):
    """No row for each component, and the sums of a broadcast table's vectors are all that is shuffled."""
    table = spark.createDataFrame([(k, [float(k), 1.0, -2.0]) for k in range(4)], "token long, vector array<float>")
    tokens = spark.createDataFrame([(1, 1), (1, 1), (1, 3), (2, 2), (2, 9), (3, 9), (None, 0)], "id long, token long")
    want = {1: [5.0, 3.0, -6.0], 2: [2.0, 1.0, -2.0], None: [0.0, 1.0, -2.0]}
    number = {1: 3, 2: 1, None: 1}
    for small in (True, False):
        for unit in (True, False):
            found = vectors.pooled(tokens, table, "id", "token", "vector", unit, small)
            assert "Generate" not in _plan(found)
            got = {r["id"]: r["vector"] for r in found.collect()}
            assert got.keys() == want.keys()
            for i, v in want.items():
                by = sum(x * x for x in v) ** 0.5 if unit else number[i]
                assert all(abs(a - b / by) < 1e-12 for a, b in zip(got[i], v, strict=True))
    assert vectors.pooled(tokens, table.limit(0), "id", "token", "vector").count() == 0


def test_query_terms_reads_the_query_once(spark):
    """The split of the query stands in the plan once, not once more inside the function of each part."""
    rows = spark.createDataFrame([("  aB_c getHTTPOf GETHttpof x ab_C c  ",), ("",), (None,)], "q string")
    found = rows.select(textops.query_terms(F.col("q")).alias("t"))
    assert _plan(found).count(r"[^\p{IsAlphabetic}\p{N}_]+") == 1
    got = found.collect()
    assert [t["term"] for t in got[0]["t"]] == ["aB_c", "aB", "c", "getHTTPOf", "get", "HTTP", "Of", "Httpof", "x"]
    assert got[1]["t"] == []
