"""Every query of the core against its SQL over the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tempolink import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "None"
        if isinstance(v, float):  # pandas has whole numbers with gaps as floats
            return str(int(v)) if v.is_integer() else f"{v:.6f}"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    want = db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = normal(got), normal(want)
    assert a == b


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 225
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark):
    """The grid and the written blocks without a cut; test_query compares them with their SQL."""
    assert queries.stack_index(spark, SF).count() == 150  # customers
    assert queries.blocks_roundtrip_whole(spark, SF).count() == 15 * 15
