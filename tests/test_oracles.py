"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from panelspark.plans import queries as plans

from .conftest import DATA

NAMES = ["ingest_year_derivation", "factor_table", "next_prev_trading_day", "asof_by_key", "fundamental_ratios", "composite_score", "score_dynamics", "investment_ranking", "forward_labels", "decile_selection", "daily_long_short", "performance_stats", "performance_report", "max_drawdown", "hit_rates", "partition_pruned_scan", "cohort_nav", "cohort_nav_carried", "factor_files", "factor_file_rejects", "snapshot_files", "incremental_snapshots", "long_series_return", "half_open_growth", "return_series_reader", "text_delisting_returns", "report_sink", "impute_with_flags", "ridge_moments", "ridge_ranking_ratios", "ols_factor_report", "rolling_moments", "rolling_alpha"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([None if v != v or v is None else round(v, 7) + 0.0 if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    assert plain(plans.QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(plans.ORACLE[name]).df())


def test_no_nested_loop_on_the_daily_panel(spark):
    p = plans.Panels(spark, DATA)
    plan = plans.portfolio.held_returns(p.selection, p.returns_d)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(plans.ORACLE) <= set(e.oracle_sql()) and set(plans.QUERIES) <= set(e.queries())
