"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(df):
    out = pd.DataFrame()
    for c in sorted(df.columns):
        numbers = pd.to_numeric(df[c], errors="coerce")
        text = df[c].notna() & numbers.isna()
        out[c] = df[c].astype(str) if text.any() else numbers.astype(float)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = normal(got), normal(want)
    for c in got.columns:
        if got[c].dtype == float:
            np.testing.assert_array_equal(got[c].to_numpy(), want[c].to_numpy(), err_msg=c)
        else:
            assert list(got[c]) == list(want[c]), c


def test_entry(spark):
    assert contract.entry(spark).count() == 2
