"""Every query of the ledger against its SQL twin in DuckDB, and the plans' shapes."""

import pandas as pd
import pytest

from snapledger.plans import catalog


def rows(df, columns):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 9) if not isinstance(v, (str, bool)) else v

    return sorted(str([one(v) for v in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["J01_manifest_diff", "J02_match_anchors", "J03_unknown_objects", "J08_check_stubs", "J11_enrich_missing", "C03_retention_plan", "C06_full_write_plan"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    physical = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # the only cross join allowed is the fixtures' with the five snapshots
    assert physical.count("NestedLoop") + physical.count("CartesianProduct") <= plan.count("Join Cross")


def test_scans_read_only_what_they_need(spark, sf_dir):
    physical = catalog.QUERIES["R04_performance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in physical
    assert "props" not in physical.split("ReadSchema:")[1]


def test_entry_runs(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
