"""Vector retrieval: top k by inner product under filters, pairs above a cosine, first near duplicates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfold.functions.textops import has_all_tags
from wrenfold.functions.vectors import dot
from wrenfold.schema import NEAR_DUPLICATE, SCORE_FLOOR

#: Rows of a block in a block-wise comparison, about.
BLOCK = 4096


def vector_top(
    records: DataFrame, query: list[float], k: int, floor: float = SCORE_FLOOR, scope: str | None = None, tags: list[str] = [], id_col: str = "id", vector_col: str = "embedding"  # noqa: B006
) -> DataFrame:
    """(id, score) of the k records of the largest inner product, at least floor. Filters go before the scores.

    The floor is applied after the limit, which it commutes with, so each score is computed once.
    """
    if not query:
        return records.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    rows = records.where(F.size(vector_col) == len(query))
    if scope is not None:
        rows = rows.where(F.col("project_scope") == scope)
    if tags:
        rows = rows.where(has_all_tags(F.col("tags"), tags))
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(F.col(id_col).alias("id"), dot(F.col(vector_col), asked).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k).where(F.col("score") >= floor)


def _frame(**columns: list | np.ndarray) -> pd.DataFrame:
    """Columns of plain objects, which Spark converts by its own schema, empty ones too."""
    return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _blocks(rows: DataFrame, count: str, mine: str, other: str, others: str) -> DataFrame:
    """Rows with their own block, and a copy for each block of the other side; the columns count and others say of how many."""
    own = F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    return rows.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop(count, others)


def compare(left: DataFrame, right: DataFrame, within: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """within(left block, right block) for all pairs of blocks that agree in scope (null only with null) and width.

    left and right: (id, scope, vector, ...). Blocks are dealt by hash, so a scope that holds most rows is many tasks;
    as many to a scope as it needs, so rows of a small scope are not copied, and rows of a scope of one side go at once.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).toDF(*right.columns)  # may be left itself
    usable = lambda rows: rows.where(F.size("vector") > 0).withColumns({"width": F.size("vector"), "no_scope": F.col("scope").isNull(), "scope": F.coalesce("scope", F.lit(""))})
    left, right, same = usable(left), usable(right), ["scope", "no_scope", "width"]
    number = lambda rows, name: rows.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    counts = number(left, "a").join(number(right, "b"), same)
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    keys = [*same, "lb", "rb"]
    lefts = _blocks(left.join(counts, same), "a", "lb", "rb", "b").groupBy(*keys)
    rights = _blocks(right.join(counts, same), "b", "rb", "lb", "a").groupBy(*keys)
    return lefts.cogroup(rights).applyInPandas(lambda x, y: within(x, y), schema)


def cosine_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine), a < b, of all rows (id, scope, vector) in one scope with a cosine of at least `least`."""

    def within(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return _frame(a=[], b=[], cosine=[])
        c = np.clip(_unit(x["vector"]) @ _unit(y["vector"]).T, -1, 1)
        i, j = np.nonzero(c >= least)
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        ok = a < b
        return _frame(a=a[ok], b=b[ok], cosine=c[i, j][ok])

    kind = dict(rows.dtypes)["id"]
    return compare(rows, rows, within, f"a {kind}, b {kind}, cosine double")


def near_duplicates(incoming: DataFrame, existing: DataFrame, least: float = NEAR_DUPLICATE) -> DataFrame:
    """(id, match): for each incoming row with a near duplicate among the existing, the latest such.

    incoming: (id, scope, vector), existing: also updated_at. The latest, not the nearest, counts; equal times by id.
    """

    def within(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return _frame(id=[], match=[], age=[])
        y = y.sort_values(["age", "id"], kind="stable")
        near = _unit(x["vector"]) @ _unit(y["vector"]).T >= least
        some = near.any(axis=1)
        first = near[some].argmax(axis=1)
        return _frame(id=x["id"].to_numpy()[some], match=y["id"].to_numpy()[first], age=y["age"].to_numpy()[first])

    kind, other = dict(incoming.dtypes)["id"], dict(existing.dtypes)["id"]
    aged = existing.select("id", "scope", "vector", (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("age"))
    found = compare(incoming, aged, within, f"id {kind}, match {other}, age long")
    return found.groupBy("id").agg(F.min(F.struct("age", "match"))["match"].alias("match"))
