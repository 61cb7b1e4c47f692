"""How a segment is written: each group's rows as they are made, by token, without a sort of Spark's."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrame, DataFrameWriter

from wrenfold.operators import blocks
from wrenfold.operators.blocks import BlockIndex

WEIGHTS = {"title": 10.0, "body": 1.0}


@pytest.mark.parametrize("stemmed", [True, False])
def test_groups_are_sorted_where_they_are_made(spark, tmp_path, monkeypatch, stemmed):
    def never(*_, **__):
        raise AssertionError("a sort of wide rows")

    rows = [(f"e{i}", i, "Ab b" if i % 3 else None, " ".join(f"w{i * k % 37}" for k in range(9)) + " hoping hopes ünder") for i in range(9000)]
    index = BlockIndex(spark, f"file://{tmp_path}/i", WEIGHTS, stemmed=stemmed)
    made = spark.createDataFrame(rows, "entry_id string, seq long, title string, body string").coalesce(1)  # two groups, in one file
    monkeypatch.setattr(type(made), "sortWithinPartitions", never)
    monkeypatch.setattr(DataFrameWriter, "partitionBy", never)
    index.add(made, 1)
    monkeypatch.undo()
    assert issubclass(type(made), DataFrame)
    groups = {}
    for file in (tmp_path / "i" / "segment=1-1" / "rows").glob("*.parquet"):
        for r in pq.read_table(file).to_pylist():
            if r["token"] is not None:
                groups.setdefault((file, r["first"]), []).append(r["token"].encode())
    assert len(groups) == 2 and all(x == sorted(set(x)) for x in groups.values())
    records = index._read("records", blocks.RECORDS, ["1-1"]).select("entry_id", "seq").collect()
    assert sorted(map(tuple, records)) == sorted((r[0], r[1]) for r in rows)
