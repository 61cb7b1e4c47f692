"""Corpus preparation: quality rules, language identification, near-duplicate removal and packing, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet to the shared folder and reads it back as the next one's docs.

Defined cases: the rules and the language judge each row by its own text, so repeated rows stay or go together and
null ids need no special care; a row is carried as one struct, so no column name can clash; a null or empty text
has no words and fails the rules; an empty table passes through as one. The near-duplicate stage keeps one row of
each component, that of the least doc_id (nulls last), then of the least text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.llm import jaccard, language_id, packing, quality_rules
from wrenfold.llm.common import read_table, written

#: Least share of a document's words that must be in its language.
LEAST_SHARE = 0.5
#: Words of a shingle, and the Jaccard similarity of shingle sets from which documents are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("doc"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fail no rule of policy v2."""
    entries = quality_rules.ledger(_carried(docs), id_col="doc")
    return entries.where(quality_rules.verdict("v2")).select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that four of five folds of ids teach."""
    model = language_id.train(docs.where(~language_id.in_fold("doc_id", 5)))
    found = language_id.predict(_carried(docs), model, id_col="doc")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of at least that similarity link."""
    return jaccard.one_of_each(docs, size=SHINGLE, least=SIMILARITY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("packing", packing_stage),
]

#: No SQL expresses a conditional random field or a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
