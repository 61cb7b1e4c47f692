"""Hybrid retrieval: reciprocal rank fusion of keyword and vector candidates, then the winners' records.

Candidates are narrow (id, score) rows; wide records are read for the winners alone. Ties go by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenfold.functions.textops import has_all_tags
from wrenfold.operators.lexical import Term, bm25, top
from wrenfold.operators.similarity import vector_top
from wrenfold.schema import RANK_CONSTANT, SCORE_FLOOR


def candidates(limit: int) -> int:
    """How many of each side are fused."""
    return max(10 * limit, 50)


def ranked(scores: DataFrame, name: str, best_first: bool) -> DataFrame:
    """(id, rank, score) from 1; scores holds the few candidates of one side."""
    order = Window.orderBy(F.desc("score") if best_first else F.asc("score"), "id")
    return scores.select("id", F.row_number().over(order).alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))


def fuse(keyword: DataFrame, semantic: DataFrame, constant: int = RANK_CONSTANT) -> DataFrame:
    """(id, score, keyword_rank, semantic_rank, ...) of whatever is on either side."""
    both = keyword.join(semantic, "id", "full_outer")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", part("keyword_rank") + part("semantic_rank"))


def hybrid(
    records: DataFrame,
    rows: DataFrame,
    terms: list[Term],
    weights: dict[str, float],
    total: int,
    mean: float,
    vector: list[float] | None,
    limit: int = 5,
    scope: str | None = None,
    tags: list[str] = [],  # noqa: B006
    prefilter: bool = False,
    floor: float = SCORE_FLOOR,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """The winners' records with score, ranks, similarity, ranking and place.

    Scope and tags filter the vector side first but the keyword side last, after the cut to `limit`, so fewer rows
    may come back than match; prefilter cuts after filtering instead. vectors: a frame of its own for the vector side,
    with the columns that it filters by, else the records'.
    """
    k = candidates(limit)
    keyword = ranked(top(bm25(rows, terms, weights, total, mean), k), "keyword", False)
    semantic = ranked(vector_top(records if vectors is None else vectors, vector or [], k, floor, scope, tags), "semantic", True)
    fused = fuse(keyword, semantic)
    fits = F.lit(True) if scope is None else F.coalesce(F.col("project_scope") == scope, F.lit(False))
    if tags:
        fits &= has_all_tags(F.col("tags"), tags)
    if prefilter:
        chosen = fused.join(records.where(fits).select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)
    else:
        chosen = fused.orderBy(F.desc("score"), "id").limit(limit)
    order = Window.orderBy(F.desc("score"), "id")
    label = "reciprocal_rank_fusion" if vector is not None else "lexical_only"
    found = records.join(F.broadcast(chosen), "id").where(fits)  # `limit` rows at most
    return found.withColumns({"ranking": F.lit(label), "place": F.row_number().over(order)})


def candidate_count(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row: candidates of both sides, those on both counted twice."""
    return keyword.select("id").unionAll(semantic.select("id")).agg(F.count(F.lit(1)).alias("candidate_count"))
