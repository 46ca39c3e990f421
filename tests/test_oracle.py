"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402

SF = os.environ.get("DPMINE_TEST_SF", "/root/testdata/sf0.001")
from dpmine.plans.catalog import QUERIES  # noqa: E402
from dpmine.plans.oracle import SQL  # noqa: E402

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_key_has_oracle_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(E.queries())


@pytest.fixture
def stored_plans(monkeypatch):
    """Plans of every stage that a query stores on its way."""
    from pyspark.sql.readwriter import DataFrameWriter
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kw):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kw)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return plans


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key, stored_plans):
    df = E.queries()[key](spark, SF)
    got = df.toPandas()
    want = duck.execute(E.oracle_sql()[key]).df()
    for plan in [*stored_plans, df._jdf.queryExecution().executedPlan().toString()]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and "mrr_at_10" in df.columns
