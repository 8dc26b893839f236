"""Every query runs on the smallest tables, and equals its DuckDB twin."""

import os

import duckdb
import pandas as pd
import pytest

from aeroframe import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def _rows(df: pd.DataFrame) -> list:
    shown = lambda x: "" if x is None or not isinstance(x, (list, tuple)) and pd.isna(x) else f"{float(x):.7g}" if isinstance(x, (float, int)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "fi" else str(x)
    return sorted(tuple(shown(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
