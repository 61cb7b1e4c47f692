"""Embedders: steps of a plan that give each row the vector of a text.

A store takes any object with `add(rows, text, into)`, which returns rows with one more column, or a function from a
column to a column, which `embedder` wraps. Without an embedder, or where a model cannot be read, a store searches by
keywords alone (`loaded`).

A `TableEmbedder` takes a table of token vectors. Rows are known by their text's digest: distinct texts are shuffled
once by it, and are tokenised, joined to the table and pooled in that partitioning. The table is a
vocabulary's, not a corpus's; it is broadcast up to BROADCAST bytes, as measured. Beyond, counted tokens and table meet by a
shuffle over SALTS parts of each token, since every text has the most frequent ones.

Defined cases: a null text is empty; a text without a token of the table takes a zero vector, which nothing is near
to; tokens beyond the table are skipped; rows of equal text share a vector, and none is lost or doubled; columns of
rows may have any names but those that begin with `_embed`.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from wrenfold.functions.vectors import pooled
from wrenfold.sources.embeddings import read_table

#: Bytes of a token table that are sent to every executor; parts of a token where it is larger.
BROADCAST, SALTS = 64 << 20, 16


class Embedder(Protocol):
    def add(self, rows: DataFrame, text: Column, into: str = "embedding") -> DataFrame:
        """rows with the column `into`, an array<float>."""


class ColumnEmbedder:
    """An embedder that is an expression."""

    def __init__(self, expression: Callable[[Column], Column]):
        self.expression = expression

    def add(self, rows: DataFrame, text: Column, into: str = "embedding") -> DataFrame:
        return rows.withColumn(into, self.expression(text).cast("array<float>"))


def tokenizer_ids(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """From a text to its token ids, by a tokenizer's file, which is read once and sent to the tasks."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    if raw is None:
        raise FileNotFoundError(path)
    content = spark.sparkContext.broadcast(bytes(raw[0]).decode("utf-8"))

    @F.pandas_udf(ArrayType(LongType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(content.value)
        model.no_truncation()
        model.no_padding()
        for batch in batches:
            yield pd.Series([e.ids for e in model.encode_batch([t or "" for t in batch], add_special_tokens=False)], dtype=object)

    return ids


class TableEmbedder:
    """Sums of token vectors at length one (unit), or their means.

    table: (token long, vector); tokens: an expression from a text to an array of tokens.
    """

    def __init__(self, table: DataFrame, tokens: Callable[[Column], Column], unit: bool = True, broadcast: int = BROADCAST):
        self.table, self.tokens, self.unit = table.select(F.col("token").cast("long"), F.col("vector").cast("array<float>")), tokens, unit
        n, least, most = self.table.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if not n or least != most or most < 1:
            raise ValueError("the token table needs vectors of one width")
        self.width = most
        self.small = n * (4 * most + 16) <= broadcast

    def add(self, rows: DataFrame, text: Column, into: str = "embedding") -> DataFrame:
        keyed = rows.withColumn("_embed_text", F.coalesce(text.cast("string"), F.lit("")))
        keyed = keyed.withColumn("_embed_key", F.unhex(F.sha2("_embed_text", 256)))
        texts = keyed.groupBy("_embed_key").agg(F.first("_embed_text").alias("t"))
        tokens = texts.select("_embed_key", F.explode(self.tokens(F.col("t")).cast("array<long>")).alias("token"))
        table = self.table
        if not self.small:
            tokens = tokens.withColumn("token", F.col("token") * SALTS + F.pmod(F.xxhash64("_embed_key"), F.lit(SALTS)))
            parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            table = table.withColumn("part", parts).select((F.col("token") * SALTS + F.col("part")).alias("token"), "vector")
        found = pooled(tokens, table, "_embed_key", "token", "vector", self.unit, self.small, self.width).select("_embed_key", F.col("vector").cast("array<float>").alias(into))
        zero = F.array_repeat(F.lit(0.0).cast("float"), self.width)
        joined = keyed.drop("_embed_text", into).join(found, "_embed_key", "left")
        return joined.withColumn(into, F.coalesce(into, zero)).drop("_embed_key")


def embedder(given: Embedder | Callable[[Column], Column] | None) -> Embedder | None:
    return given if given is None or hasattr(given, "add") else ColumnEmbedder(given)


def loaded(spark: SparkSession, matrix: str, tokenizer: str, unit: bool = True) -> TableEmbedder | None:
    """The embedder of a tensor file and a tokenizer's file; None, with a warning, where one cannot be read."""
    try:
        return TableEmbedder(read_table(spark, matrix), tokenizer_ids(spark, tokenizer), unit)
    except Exception as e:  # whatever is wrong with the files, keywords are left
        logging.getLogger(__name__).warning("no embedding model, keywords alone: %s", str(e).splitlines()[0])
        return None
