"""Every registered query of the market part against its SQL on the small tables."""

import math

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
MODELS = {"train_gbt", "train_gbt_small", "train_logreg", "feature_importance", "walk_forward_cv", "online_retrain", "ml_signal", "backtest_model", "stream_scores"}
#: Queries whose rows depend on a total order: small tables hold too few ties.
ORDERED = ["equity_curve", "trade_log", "streaks", "stop_loss_cut", "trailing_stop", "direction_cap", "max_drawdown", "backtest_summary"]
#: Most scans of a file and exchanges of the whole plan, the staged tables that it reads among them.
BOUNDS = {"momentum": (3, 6), "price_trend": (3, 6), "realized_vol": (2, 3), "rule_signal": (10, 24), "consensus_signal": (10, 26), "backtest_summary": (10, 16), "fold_stats": (8, 16), "training_set": (8, 12)}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


def same(a, b):
    return a == b or (isinstance(a, int | float) and isinstance(b, int | float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


def compared(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    want = db.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got, expected = plain(df.collect(), df.columns, names), plain(want.fetchall(), list(want.columns), names)
    assert len(got) == len(expected)
    assert all(same(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    compared(spark, sf_dir, db, name)


@pytest.mark.parametrize("name", ORDERED)
def test_matches_sql_where_rows_tie(spark, sf_dir, name):
    folder = f"{sf_dir.rsplit('/', 1)[0]}/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    compared(spark, folder, con, name)


@pytest.mark.parametrize("name", sorted(BOUNDS))
def test_plans_stay_linear(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = BOUNDS[name]
    assert plan.count("FileScan") <= scans and plan.count("Exchange ") <= exchanges


def test_queries_without_sql_are_tested_elsewhere():
    assert set(QUERIES) - set(ORACLES) == MODELS


def test_the_dashboard_joins_its_ledger_once(spark, sf_dir):
    plan = QUERIES["performance_dashboard"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan  # what the parts read is the staged ledger
