"""Every registered variant query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pandas as pd
import pytest

from strandloom import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(v) if isinstance(v, (str, bool)) else f"{float(v):.5f}"

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got, want = core.queries()[name](spark, FOLDER).toPandas(), duck.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got), "an empty result proves nothing"
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert core.queries()[name](spark, FOLDER).count() > 0


def test_entry_without_and_with_the_subpackage():
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
