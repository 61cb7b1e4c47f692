"""A versioned record log: the current state, history, upsert, delete and rollback as plans over it.

The log has a row for each write: (entry_id, seq, op, at, the record's columns). seq orders all writes, op is one of
insert, update, merge, delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(log: DataFrame) -> DataFrame:
    """The last row of each entry that is not deleted. Tasks keep one row an entry before the shuffle."""
    last = log.groupBy("entry_id").agg(F.max_by(F.struct(*log.columns), "seq").alias("r"))
    return last.select("r.*").where(F.col("op") != "delete")


def live(log: DataFrame, *columns: str) -> DataFrame:
    """(entry_id, seq, columns) of the current rows: what current() keeps, without its texts in the shuffle."""
    last = log.groupBy("entry_id").agg(F.max_by(F.struct("seq", "op", *columns), "seq").alias("r"))
    return last.where(F.col("r.op") != "delete").select("entry_id", "r.seq", *[f"r.{c}" for c in columns])


def history(log: DataFrame) -> DataFrame:
    """A row for each overwritten state: its content, version from 1, and the operation and time that overwrote it.

    A delete overwrites nothing, and leaves the history.
    """
    by_seq = Window.partitionBy("entry_id").orderBy("seq")
    states = log.where("op <> 'delete'")
    over = states.withColumns({"version": F.row_number().over(by_seq).cast("int"), "operation": F.lead("op").over(by_seq), "timestamp": F.lead("at").over(by_seq)})
    return over.where(F.col("operation").isNotNull()).drop("op", "at")


def next_version(log: DataFrame) -> DataFrame:
    """(entry_id, version): the number that the next overwritten state of each entry gets."""
    return history(log).groupBy("entry_id").agg((F.max("version") + 1).alias("version"))


def appended(log: DataFrame, writes: DataFrame) -> DataFrame:
    return log.unionByName(writes, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The existing rows that no incoming row replaces, and the incoming rows; created_at of replaced rows stays."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    if "created_at" in existing.columns:
        was = existing.select(key, F.col("created_at").alias("was"))
        incoming = incoming.join(was, key, "left").withColumn("created_at", F.coalesce("was", "created_at")).drop("was")
    return kept.unionByName(incoming)


def deleted(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return existing.join(ids, key, "left_anti")


def rolled_back(log: DataFrame, wanted: DataFrame, at: Column, seq: Column, lost: tuple[str, ...] = ("embedding", "dedup_key")) -> DataFrame:
    """The writes that bring (entry_id, version) rows back: an update each, without what history does not keep."""
    old = history(log).join(wanted, ["entry_id", "version"]).drop("version", "operation", "timestamp", "seq")
    empty = {c: (F.array().cast(dict(log.dtypes)[c]) if c == "embedding" else F.lit(None).cast(dict(log.dtypes)[c])) for c in lost if c in log.columns}
    return old.withColumns({**empty, "op": F.lit("update"), "at": at, "seq": seq}).select(*log.columns)
