"""Hand-computed cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x, kind="double"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(("bid", "ask", "mid", "spread"), [(24, 26, 0.25, 0.02), (24, None, 0.24, None), (None, 26, 0.26, None), (0, 0, None, None)])
def test_quotes(spark, bid, ask, mid, spread):
    r = one(spark, mid=S.mid_price(lit(bid, "int"), lit(ask, "int")), spread=S.spread(lit(bid, "int"), lit(ask, "int")))
    assert (r.mid, r.spread) == (mid, spread)


@pytest.mark.parametrize(("c", "p", "taker", "maker"), [(1, 0.5, 0.02, 0.01), (1, 0.0, 0, 0), (1, 1.0, 0, 0), (0, 0.5, 0, 0)])
def test_fees(spark, c, p, taker, maker):
    r = one(spark, t=S.taker_fee(lit(c), lit(p)), m=S.maker_fee(lit(c), lit(p)))
    assert (r.t, r.m) == (taker, maker)


@pytest.mark.parametrize(("side", "yes", "pnl"), [("YES", True, 1.19), ("YES", False, -0.81), ("NO", False, 0.79), ("NO", True, -1.21), ("YES", None, None)])
def test_payoff(spark, side, yes, pnl):
    assert one(spark, p=S.binary_payoff(F.lit(side), lit(yes, "boolean"), lit(2), lit(0.4), lit(0.01))).p == pnl


def test_book(spark):
    levels = lambda x: F.lit(None).cast("array<array<double>>") if x is None else F.from_json(F.lit(x), "array<array<double>>")
    yes, no = S.best_asks(levels("[[40,5]]"), levels("[[55,3]]"))
    e_yes, e_no = S.best_asks(levels("[]"), levels("[]"))
    r = one(spark, yes=yes, no=no, e_yes=e_yes, e_no=e_no, i=S.book_imbalance(lit(30), lit(10)), none=S.book_imbalance(lit(0), lit(0)), d=S.depth(levels("[[1,30],[2,4]]")), dn=S.depth(levels(None)))
    assert tuple(r) == (45, 60, 99, 99, 0.5, None, 34, 0)


@pytest.mark.parametrize("z", [-6, -2.5, -1, -0.01, 0, 0.3, 1.7, 4])
def test_norm_cdf(spark, z):
    assert one(spark, p=S.norm_cdf(lit(z))).p == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-7)


def test_consensus_levels(spark):
    def edge(n_valid, agreement, side, cside, mid=0.5, p=0.6, conflict=False):
        return one(spark, s=S.consensus(lit(0.5), lit(8, "int"), lit(n_valid, "int"), lit(agreement), F.lit(side), F.lit(cside), lit(p), lit(1.0), lit(mid), F.lit(conflict))).s

    assert edge(4, 1.0, "YES", "YES")[:3] == ("YES", pytest.approx(0.04), "consensus")
    assert edge(4, 0.75, "YES", "YES")[:3] == ("YES", pytest.approx(0.025), "consensus")
    assert edge(4, 1.0, "NO", "YES").side is None  # against all others
    assert edge(4, 1.0, "YES", "YES", conflict=True).mode == "conflict"
    assert edge(4, 1.0, "YES", "YES", mid=0.85).side is None  # too dear
    assert edge(2, 0.5, "YES", "YES").confidence == pytest.approx(0.125)
    assert edge(3, 2 / 3, "YES", "YES").confidence == pytest.approx(0.075)


def test_gates_in_order(spark):
    def reason(name, mid, tte, width, side="YES"):
        return one(spark, r=S.gate_reason(S.RISK_CONFIGS[name], lit(mid), lit(tte), lit(width), F.lit(side))).r

    assert reason("backtest", None, 300, 0.01) == "missing_data"
    assert reason("backtest", 0.2, 10, 0.9) == "mid_outside_range"
    assert reason("backtest", 0.5, 10, 0.9) == "tte_outside_window"
    assert reason("backtest", 0.5, 300, 0.9) == "spread_too_wide"
    assert reason("backtest", 0.5, 300, None) == "ok"
    assert reason("live", 0.5, 630, 0.01) == "tte_blackout"
    assert reason("paper", 0.7, 300, 0.01) == "price_too_high"
    assert reason("paper", 0.7, 300, 0.01, "NO") == "ok"


def test_times_and_tickers(spark):
    r = one(spark, z=S.parse_close_time(F.lit("2026-02-24T12:00:00Z")).cast("string"), bad=S.parse_close_time(F.lit("soon")), clock=S.minutes_seconds(lit(125.0)), key=S.ticker_part(F.lit("KX-A-B"), "period_key"), time=S.ticker_part(F.lit("KX-A-B"), "time_key"), none=S.ticker_part(F.lit("KX"), "period_key"), limit=S.limit_price_cents(F.lit("NO"), lit(None, "int"), lit(60, "int"), lit(0.5)))
    assert tuple(r) == ("2026-02-24 12:00:00", None, "2:05", "A-B", "A", None, 40)


def test_bins_close_at_the_end(spark):
    from tidemark.plans.ticks import TTE_EDGES, TTE_LABELS

    got = [r.b for r in spark.createDataFrame([(0.0,), (60.0,), (900.0,), (901.0,)], "v double").select(S.binned(F.col("v"), TTE_EDGES, TTE_LABELS).alias("b")).collect()]
    assert got == ["0-1m", "1-3m", "12.5-15m", None]


def test_gates_by_position(spark):
    c, mid, tte, spread, side = S.RISK_CONFIGS["backtest"], lit(0.5), lit(300), lit(0.02), F.lit("YES")
    ask = lambda **more: one(spark, r=S.gate_reason(c, mid, tte, spread, side, **more)).r
    assert ask() == "ok" == ask(held=F.lit(False), exposure=lit(0.1499), same_direction=lit(1, "int"))
    assert ask(held=F.lit(True), exposure=lit(1.0)) == "in_position"
    assert ask(exposure=lit(0.15), same_direction=lit(2, "int")) == "exposure_limit"
    assert ask(same_direction=lit(2, "int")) == "max_same_direction"


@pytest.mark.parametrize(("price", "edge", "room", "size"), [(0.35, 0.05, 9.0, 2), (0.36, 0.05, 9.0, 1), (0.7, 0.02, 9.0, 0), (0.7, 0.04, 9.0, 1), (0.3, 0.05, 0.5, 1), (0.3, 0.05, 0.2, 0), (0.5, 0.025, 9.0, 0)])
def test_tiered_size(spark, price, edge, room, size):
    assert one(spark, n=S.tiered_size(lit(edge), lit(price), lit(room))).n == size


@pytest.mark.parametrize(("asset", "volatility"), [("btc", 0.15), ("sol", 0.35), ("none", 0.2), (None, 0.2)])
def test_default_volatility(spark, asset, volatility):
    assert one(spark, v=S.default_volatility(lit(asset, "string"))).v == volatility


@pytest.mark.parametrize(("rows", "gaps", "status"), [(2700, 4.9, "OK"), (2700, 5.0, "PARTIAL"), (1500, 0.0, "PARTIAL"), (1499, 0.0, "INSUFFICIENT")])
def test_final_status(spark, rows, gaps, status):
    assert one(spark, s=S.final_status(lit(rows, "long"), lit(gaps))).s == status
