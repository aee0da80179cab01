"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strata.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query(spark, sf_dir, db, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    keys = [c for c in cols if ours[c].dtype != float] or cols
    a, b = (x[cols].sort_values(keys, ignore_index=True) for x in (ours, theirs))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
