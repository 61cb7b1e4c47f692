"""Keyword retrieval: postings as rows, and column-weighted BM25 over them.

Postings hold one row a token: (id, col, pos, token, n), n the tokens of the whole record. They are either made from
the records on the fly, when the query's terms filter them in the scanning task before anything is shuffled, or kept
sorted by token, when the terms' ranges prune row groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.stemming import stem, stem_all, stem_each, tokens
from wrenfold.functions.textops import query_terms

#: Fixed values of the ranking formula: k1, b, and what an idf of zero or less becomes.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Term:
    """Adjacent tokens, of which the last may be the start of a longer one."""

    parts: tuple[str, ...]
    prefix: bool


def terms_of(spark: SparkSession, query: str, stemmed: bool = True) -> list[Term]:
    """The terms of one query: identifiers whole and in parts, each a phrase of its tokens."""
    found = spark.range(1).select(F.explode(query_terms(F.lit(query))).alias("t")).select("t.*", tokens(F.col("t.term")).alias("parts")).collect()
    return [Term(tuple(stem(p) if stemmed else p for p in r["parts"]), r["prefix"]) for r in found if r["parts"]]


def _begins(part: str, stemmed: bool) -> str:
    """What every word starts with whose token is, or starts with, part.

    A stem is the start of its word, but that it may end in an e that was added, an i that was a y, or the bl(e) of a
    bility.
    """
    if not stemmed:
        return part
    return part[:-2] if part.endswith("ble") else part[:-1] if part.endswith(("bl", "e", "i")) else part


def postings(records: DataFrame, columns: tuple[str, ...], id_col: str = "id", stemmed: bool = True, fold: bool = True, terms: list[Term] | None = None) -> DataFrame:
    """A row for each token of the columns; an array column counts as its items joined by spaces.

    terms: only rows that these may ask for; other words are left out before any is stemmed.
    """
    kinds = dict(records.dtypes)
    text = lambda c: F.concat_ws(" ", c) if kinds[c].startswith("array") else F.col(c)
    each = records.select(F.col(id_col).alias("id"), *[tokens(text(c), fold).alias(c) for c in columns])
    each = each.select("id", F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("words")) for c in columns]).alias("fields"))
    each = each.withColumn("n", F.aggregate("fields", F.lit(0), lambda s, f: s + F.size(f["words"])))
    each = each.select("id", "n", F.inline("fields"))
    if terms is None:
        words = stem_all("words") if stemmed else F.col("words")
        return each.select("id", "col", "n", F.posexplode(words).alias("pos", "token"))
    rows = each.select("id", "col", "n", F.posexplode("words").alias("pos", "token"))
    starts = {_begins(p, stemmed) for t in terms for p in t.parts}
    rows = rows.where(reduce(lambda a, b: a | b, [F.startswith("token", F.lit(b)) for b in sorted(starts)], F.lit(False)))
    return rows.withColumn("token", stem_each("token")) if stemmed else rows


def keep(rows: DataFrame, path: str) -> DataFrame:
    """Writes postings sorted by token, so that a term's range prunes them, and reads them back.

    Ranges are of token and record, so the postings of a common token are many partitions.
    """
    rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def length(records: DataFrame, columns: tuple[str, ...]) -> Column:
    """Tokens of a record."""
    kinds = dict(records.dtypes)
    text = lambda c: F.concat_ws(" ", c) if kinds[c].startswith("array") else F.col(c)
    return reduce(lambda a, b: a + b, [F.regexp_count(F.lower(F.coalesce(text(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+")) for c in columns])


def sizes(records: DataFrame, columns: tuple[str, ...]) -> tuple[int, float]:
    """Records, and mean tokens of a record."""
    row = records.select(length(records, columns).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    return row[0], (row[1] or 0) / max(1, row[0])


def _matches(token: Column, part: str, prefix: bool) -> Column:
    return token.startswith(part) if prefix else token == part


def bm25(rows: DataFrame, terms: list[Term], weights: dict[str, float], total: int, mean: float) -> DataFrame:
    """(id, score) of the records that hold a term, the best lowest. total, mean: of sizes()."""
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    token = F.col("token")
    slots = [
        F.when(_matches(token, part, t.prefix and j == len(t.parts) - 1), F.struct(F.lit(k).alias("term"), F.lit(j).alias("part")))
        for k, t in enumerate(terms)
        for j, part in enumerate(t.parts)
    ]
    any_match = reduce(lambda a, b: a | b, [_matches(token, p, t.prefix and j == len(t.parts) - 1) for t in terms for j, p in enumerate(t.parts)])
    hits = rows.where(any_match & F.col("col").isin(*weights)).select(
        "id", "col", "n", "pos", F.explode(F.filter(F.array(*slots), lambda s: s.isNotNull())).alias("s")
    )
    weight = reduce(lambda w, c: F.when(F.col("col") == c, float(weights[c])).otherwise(w), weights, F.lit(0.0))
    if max(len(t.parts) for t in terms) > 1:
        long = F.array(*[F.lit(len(t.parts)) for t in terms])
        hits = (
            hits.groupBy("id", "col", "n", F.col("s.term").alias("term"), (F.col("pos") - F.col("s.part")).alias("at"))
            .agg(F.count(F.lit(1)).alias("parts"))
            .where(F.col("parts") == F.element_at(long, F.col("term") + 1))
        )
    else:
        hits = hits.select("id", "col", "n", F.col("s.term").alias("term"))
    found = hits.groupBy("id", "n", "term").agg(F.sum(weight).alias("f"))
    held = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term
    raw = F.log((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
    f, ratio = F.col("f"), F.col("n") / F.lit(float(mean) or 1.0)
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * ratio))
    parts = found.join(F.broadcast(held), "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", part.alias("x")))).alias("parts"))
    # at most 24 terms, added in their order, so equal records score equally to the last bit
    return parts.select("id", (-F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["x"])).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best, equal ones by id."""
    return scores.orderBy("score", "id").limit(k)
