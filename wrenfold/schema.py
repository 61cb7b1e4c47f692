"""Types, limits and constants of knowledge records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType, TimestampType

KINDS = ("workflow", "resolved_failure")

RECORD = StructType(
    [
        StructField("id", StringType()),
        StructField("title", StringType()),
        StructField("kind", StringType()),
        StructField("context", StringType()),
        StructField("content", StringType()),
        StructField("verification", StringType()),
        StructField("tags", ArrayType(StringType())),
        StructField("project_scope", StringType()),
        StructField("created_at", TimestampType()),
        StructField("updated_at", TimestampType()),
        StructField("dedup_key", StringType()),
    ]
)
VECTOR = StructField("embedding", ArrayType(FloatType()))


@dataclass(frozen=True)
class Limits:
    """Bytes, but for the number of tags."""

    query: int = 2048
    title: int = 256
    context: int = 64 * 1024
    content: int = 128 * 1024
    verification: int = 64 * 1024
    tag: int = 64
    tags: int = 32
    scope: int = 128
    line: int = 512 * 1024


@dataclass(frozen=True)
class QueryOptions:
    """Fixed values of keyword queries: bytes read, terms kept, characters from which a term is a prefix."""

    bytes: int = 1024
    terms: int = 24
    prefix: int = 3


LIMITS, QUERY_OPTIONS = Limits(), QueryOptions()
#: Weights of the searched columns, floor of vector scores, rank constant, near-duplicate cosine.
WEIGHTS = {"title": 10.0, "kind": 1.0, "context": 4.0, "content": 1.0, "verification": 2.0, "tags": 6.0}
SCORE_FLOOR, RANK_CONSTANT, NEAR_DUPLICATE = 0.35, 20, 0.92
EMBED_BYTES = 16 * 1024
