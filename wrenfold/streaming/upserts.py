"""A stream of saves into the store, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wrenfold.operators.store import KnowledgeStore
from wrenfold.schema import LIMITS

SAVES = "seq long, title string, kind string, context string, content string, verification string, tags array<string>, project_scope string, entry_id string, dedup_key string"


def _read(lines: DataFrame) -> DataFrame:
    size = F.octet_length("value")
    save = F.from_json("value", f"{SAVES}, unread string", {"columnNameOfCorruptRecord": "unread"})
    rows = lines.select("value", size.alias("bytes"), F.when(size <= LIMITS.line, save).alias("s"))
    wrong = F.when(F.col("bytes") > LIMITS.line, "longer than the bound").when(F.col("s").isNull() | F.col("s.unread").isNotNull(), "no save in JSON")
    return rows.withColumn("reason", wrong)


def parsed(lines: DataFrame) -> DataFrame:
    """Saves of JSON lines; lines above the bound, or that do not parse, are in refused()."""
    return _read(lines).where("reason is null").select("s.*").drop("unread")


def refused(lines: DataFrame) -> DataFrame:
    """(value, bytes, reason) of the lines that parsed() leaves out."""
    return _read(lines).where("reason is not null").select("value", "bytes", "reason")


def save_stream(saves: DataFrame, store: KnowledgeStore, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch with store.save(). A batch that is run again, and is in the log, is left alone."""

    def each(batch: DataFrame, number: int) -> None:
        source = f"{checkpoint}/{number}"
        if not batch.isEmpty() and not store.holds(source):
            store.save(batch, source=source)

    return saves.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
