"""Token-embedding tables from tensor files, and texts embedded with them."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from wrenfold.functions.vectors import pooled

#: Names that the matrix may have, and kinds of numbers.
NAMES = ("embeddings", "0")
KINDS = {"F32": "<f4", "F16": "<f2", "I8": "i1"}
#: Rows of a batch.
ROWS = 4096


def _matrix(raw: bytes) -> np.ndarray:
    """The 2-D matrix of a tensor file: the header's length, a JSON header, the numbers."""
    (size,) = struct.unpack("<Q", raw[:8])
    header = json.loads(raw[8 : 8 + size])
    name = next((n for n in NAMES if n in header), None)
    if name is None:
        raise ValueError(f"no tensor named {' or '.join(NAMES)}")
    spec = header[name]
    begin, end = spec["data_offsets"]
    if spec["dtype"] not in KINDS or len(spec["shape"]) != 2:
        raise ValueError("the tensor must be a matrix of F32, F16 or I8")
    flat = np.frombuffer(raw[8 + size + begin : 8 + size + end], KINDS[spec["dtype"]])
    if flat.size != spec["shape"][0] * spec["shape"][1]:
        raise ValueError("the tensor's size is not that of its shape")
    return flat.reshape(spec["shape"]).astype(np.float32)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of a tensor file, which a task reads whole: a vocabulary's size, not a corpus's."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                m = _matrix(bytes(raw))
                for at in range(0, len(m), ROWS):
                    yield pd.DataFrame({"token": np.arange(at, min(at + ROWS, len(m))), "vector": list(m[at : at + ROWS])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "token long, vector array<float>")


def embedded(texts: DataFrame, table: DataFrame, tokenizer: str, id_col: str = "id", text_col: str = "text", unit: bool = True) -> DataFrame:
    """(id, vector): the sum of a text's token vectors at length one, or their mean.

    Texts without a token of the table have no row; as records they take a zero vector, which nothing is near to.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        for batch in batches:
            yield pd.Series([e.ids for e in model.encode_batch([t or "" for t in batch], add_special_tokens=False)], dtype=object)

    tokens = texts.select(F.col(id_col), F.explode(ids(F.col(text_col)).cast("array<long>")).alias("token"))
    return pooled(tokens, table, id_col, "token", "vector", unit)
