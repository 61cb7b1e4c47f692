"""Records as JSON files, and the checks of what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.textops import kind_or
from wrenfold.schema import LIMITS, RECORD

#: In the order in which a record is written.
FIELDS = [f.name for f in RECORD.fields]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file of lines (`.jsonl`) or of a JSON array; a record that does not fit the schema fails the read."""
    reader = spark.read.schema(RECORD).option("mode", "FAILFAST")
    return reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", True).json(path)


def to_json(records: DataFrame) -> Column:
    """A record's JSON: nulls are written, but a null dedup_key is left out."""
    present = [c for c in FIELDS if c in records.columns]
    options = {"ignoreNullFields": "false"}
    without = F.to_json(F.struct(*[c for c in present if c != "dedup_key"]), options)
    return F.when(F.col("dedup_key").isNull(), without).otherwise(F.to_json(F.struct(*present), options)) if "dedup_key" in present else without


def export_lines(records: DataFrame, path: str, scope: str | None = None) -> None:
    """One record a line, in as many files as the latest-first order has partitions."""
    rows = records if scope is None else records.where(F.col("project_scope") == scope)
    rows.orderBy(F.desc("updated_at"), "id").select(to_json(rows).alias("value")).write.mode("overwrite").text(path)


def export_array(records: DataFrame, path: str, scope: str | None = None) -> None:
    """The same as JSON arrays, one a file: each partition's records are put between brackets."""
    rows = records if scope is None else records.where(F.col("project_scope") == scope)
    lines = rows.orderBy(F.desc("updated_at"), "id").select(to_json(rows).alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k"))
    ends = lines.groupBy("p").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    both = lines.join(F.broadcast(ends), "p")
    text = F.concat(F.when(F.col("k") == F.col("a"), "[").otherwise(""), F.col("value"), F.when(F.col("k") == F.col("b"), "]").otherwise(","))
    both.select(text.alias("value")).write.mode("overwrite").text(path)


def bounded_lines(lines: DataFrame, column: str = "value", most: int = LIMITS.line) -> tuple[DataFrame, DataFrame]:
    """The lines within the bound in bytes, and those beyond it with their size."""
    size = F.octet_length(column)
    return lines.where(size <= most), lines.where(size > most).withColumn("bytes", size)


def imported(records: DataFrame) -> DataFrame:
    """Records as import takes them: an unknown kind becomes `workflow`, null tags none."""
    return records.withColumns({"kind": kind_or(F.col("kind"), "workflow"), "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def string_array(value: Column) -> Column:
    """A struct of the strings of a JSON array and why it is refused; an absent value is an empty array."""
    parsed = F.from_json(value, "array<string>")
    kinds_ok = F.regexp_count(value, F.lit(r'"(?:[^"\\]|\\.)*"')) == F.size(parsed)
    reason = F.when(value.isNotNull() & (parsed.isNull() | ~F.coalesce(kinds_ok, F.lit(False))), "not an array of strings")
    return F.struct(F.when(reason.isNull(), F.coalesce(parsed, F.array().cast("array<string>"))).alias("value"), reason.alias("reason"))
