"""Every query against its SQL in DuckDB on the smallest tables, where they are there."""

import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
from lacunar.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SLOW = {"pip_1_pattern_detector", "pip_5_adbase_semi_supervised", "pip_5_adbase_ssad", "pip_3_absence_detector", "est_10b_bagging_forest"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{DATA}/{f}'")
    return con


def rows(df):
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(tuple(np.round(v, 5)) if isinstance(v, list | np.ndarray) else None if v is pd.NA or v != v else round(float(v), 5) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v for v in r))
    inexact = float | tuple
    return sorted(out, key=lambda r: (str([v for v in r if not isinstance(v, inexact)]), [v for v in r if isinstance(v, inexact)]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(name, spark, duck):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows(got[sorted(got.columns)]), rows(want[sorted(want.columns)]), strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float | tuple):
                assert np.allclose(x, y, atol=2e-4), (a, b)
            else:
                assert x == y, (a, b)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["series_id", "idx", "ts", "loc", "prob", "pred"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
