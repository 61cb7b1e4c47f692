"""What the operators of this subpackage share: intermediate tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and the five ASCII controls from tab to return.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent the session must be local, as in tests; a folder is then made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="wrenfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wrenfold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, computed once and read back from a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


#: Where the tables of written() are.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def removed(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read again; other frames are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that come in fewer splits than there are cores, as one small file does, are dealt to all."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def least_hashes(h: Column, wanted: int, total: Column) -> Column:
    """Whether a hash is among the least of `total`, four times `wanted` of them on average.

    Narrows rows in the scanning tasks before the exact choice of the `wanted` least, so that what is sorted in
    one place does not grow with the number of tasks.
    """
    share = F.least(F.lit(1.0), F.lit(4.0 * wanted) / F.greatest(total, F.lit(1)).cast("double"))
    return h.cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)
