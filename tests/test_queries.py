"""Every core query that has SQL against DuckDB, on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from leafmill.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(d):
    d = d[sorted(d.columns)]
    d = pd.DataFrame({c: [None if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in d[c]] for c in d})
    return d.fillna("∅").sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got)
        return
    pd.testing.assert_frame_equal(plain(got), plain(con.execute(SQL[name]).df()), check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
