"""Every query that SQL can express gives the rows that its SQL gives in DuckDB; the others run."""

import os

import duckdb
import pytest

from barwright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    texts = df[columns].astype(object).where(df[columns].notna(), None).map(lambda v: v.isoformat() if hasattr(v, "isoformat") else repr(float(v)) if isinstance(v, (int, float)) else repr(v))
    return columns, sorted(map(tuple, texts.to_numpy().tolist()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["permutation_importance", "wavelet_energy", "lyapunov"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.01").count() > 0
