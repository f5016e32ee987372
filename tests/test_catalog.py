"""Each registered query with SQL gives the rows of its SQL."""

import os

import duckdb
import pytest

from longleaf import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), sql.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_token_estimates(spark):
    from pyspark.sql import functions as F

    from longleaf.functions.text import estimate_tokens

    cases = {"": 0, "abcdefgh": 2, "The quick brown fox.": 5, "1234": 1, "日本": 2}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", estimate_tokens(F.col("t")).alias("n")).collect()}
    assert got == cases
