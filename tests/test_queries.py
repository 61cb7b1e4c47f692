"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SMALL

from wrenfold.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rounded(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(rounded, v)) if isinstance(v, list | tuple) else v


def same_rows(spark_df, relation):
    names = sorted(spark_df.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(rounded(r[n]) for n in names) for r in spark_df.collect()), key=repr)
    at = [relation.columns.index(n) for n in names]
    theirs = sorted((tuple(rounded(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SMALL), duck.sql(catalogue.ORACLES[name]))


def test_flagship(spark):
    assert catalogue.flagship(spark, SMALL).columns == ["id", "title", "keyword_rank", "semantic_rank", "score", "ranking"]
