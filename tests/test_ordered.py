"""Windows, as-of lookups and folds against plain restatements."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.folds import accepted, anchored_stale_seconds
from tidemark.operators.ordered import bucket_parts, islands, previous_value, row_parts, running
from tidemark.plans import bindings, signals

US = 1_000_000


@pytest.fixture(scope="module")
def series():
    rnd, rows, at = random.Random(3), [], 0
    for k in range(400):
        at += rnd.choice([0, 1, 3, 7, 40, 90_000]) * US
        rows.append((k, rnd.choice("ab"), at, None if rnd.random() < 0.2 else round(rnd.uniform(90, 110), 3)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series, "seq long, asset string, us long, v double")


def by_asset(series):
    out = {}
    for row in sorted(series, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("h", [2, 10, 60])
def test_nearest(frame, series, h, inclusive):
    want = {}
    for rows in by_asset(series).values():
        points = {}
        for r in rows:
            if r[3] is not None:
                points.setdefault(r[2], r[3])
        for r in rows:
            best = None
            for us, v in sorted(points.items()):
                gap = abs(r[2] - h * US - us)
                if (gap <= h * US / 2 if inclusive else gap < h * US / 2) and (best is None or gap < best[0]):
                    best = (gap, v)
            want[r[0]] = best and best[1]
    got = {r.seq: r.n for r in asof.nearest_before(frame, ["asset"], "v", h * US, "n", inclusive).collect()}
    assert got == want


def test_previous_and_running(frame, series):
    prev, total = {}, {}
    for rows in by_asset(series).values():
        last, made, top = None, 0.0, 0.0
        for r in rows:
            prev[r[0]] = last
            last = r[3] if r[3] is not None else last
            made += r[3] or 0.0
            top = max(top, made)
            total[r[0]] = (pytest.approx(made), pytest.approx(top))
    assert {r.seq: r.p for r in previous_value(frame, ["asset"], ["us", "seq"], F.col("v"), "p").collect()} == prev
    got = running(frame, ["asset"], ["us", "seq"], F.coalesce("v", F.lit(0.0)), "t", "m")
    assert {r.seq: (r.t, r.m) for r in got.collect()} == total


def test_volatility(frame, series):
    window, period, want = 100_000 * US, 900 * US, {}
    for rows in by_asset(series).values():
        held = [r for r in rows if r[3] is not None]
        for i, r in enumerate(held):
            ends = [j for j in range(len(held)) if r[2] - window < held[j][2] <= r[2]]
            rets = [(held[j][3] - held[j - 1][3]) / held[j - 1][3] * 100 for j in ends if j and j - 1 in ends]
            if len(rets) >= 3:
                mean = sum(rets) / len(rets)
                want[r[0]] = pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in rets) / len(rets)) * math.sqrt(len(rets) * period / window), rel=1e-6)
    got = {r.seq: r.vol for r in asof.realized_volatility(frame, ["asset"], "v", window, period, "vol").collect() if r.vol is not None}
    assert got == want


def test_asof_and_interval(spark):
    ticks = spark.createDataFrame([(1, 5), (2, 10), (3, 99), (4, 10_000)], "seq long, us long")
    states = spark.createDataFrame([(10, "x"), (50, "y"), (60, "z")], "at long, s string")
    got = {r.seq: r.s for r in asof.asof_join(ticks, states, "at", [], ["s"], 40).collect()}
    assert got == {1: None, 2: "x", 3: "z", 4: "z"}
    rolls = spark.createDataFrame([("A", 0), ("B", 0), ("C", 0)], "ticker string, us long")
    late = spark.createDataFrame([("A", 300, "YES"), ("A", 200, "NO"), ("B", 301, "YES")], "ticker string, at long, result string")
    got = {r.ticker: r.result for r in asof.interval_join(rolls, late, ["ticker"], ["ticker"], "us", "at", 300, ["result"]).collect()}
    assert got == {"A": "NO", "B": None, "C": None}


def test_streaks_pass_over_nulls(spark):
    rows = [(k, "a", k, x) for k, x in enumerate([True, True, None, True, False, False])]
    df = spark.createDataFrame(rows, "seq long, asset string, us long, win boolean")
    runs = {(r.flag, r.run) for r in islands(df, ["asset"], ["us", "seq"], F.col("win")).collect()}
    assert runs == {(True, 3), (False, 2)}


def test_anchored_clock(spark):
    df = spark.createDataFrame([(0, "a", 0, 1.0), (1, "a", 10 * US, 1.0006), (2, "a", 20 * US, 1.0012), (3, "a", 30 * US, None), (4, "b", 0, None)], "seq long, asset string, us long, p double")
    got = {r.seq: r.stale_seconds for r in anchored_stale_seconds(df, ["asset"], "p", 0.001).collect()}
    assert got == {0: 0, 1: 10, 2: 0, 3: 10, 4: 999}


@pytest.mark.parametrize("width", [50 * US, 3000 * US, 10**15])
@pytest.mark.parametrize("step", [0.0004, 0.0011, 0.003])
def test_anchored_clock_across_buckets(spark, width, step):
    """Prices that creep, jump and rest, in buckets of any width."""
    rnd, rows, price, want = random.Random(step), [], 5.0, {}
    for k in range(600):
        price += rnd.choice([-1, 0, 0, 1]) * step
        rows.append((k, rnd.choice(["a", "b", None]), k * 7 * US, None if rnd.random() < 0.1 else price if rnd.random() < 0.9 else 9.0))
    state = {}
    for seq, a, us, v in rows:
        anchor, since = state.get(a, (None, None))
        if v is not None and (anchor is None or abs(v - anchor) > 0.001):
            anchor, since = v, us
        state[a] = anchor, since
        want[seq] = 999.0 if since is None else (us - since) / US
    df = spark.createDataFrame(rows, "seq long, asset string, us long, p double").withColumn("more", F.lit("x"))
    got = anchored_stale_seconds(df, ["asset"], "p", 0.001, width_us=width)
    assert got.columns == [*df.columns, "stale_seconds"]
    assert {r.seq: r.stale_seconds for r in got.collect()} == want
    assert anchored_stale_seconds(df.limit(0), ["asset"], "p", 0.001).count() == 0


def test_accepted_values_of_long_rests():
    values = np.concatenate([np.full(5000, 1.0), np.full(5000, 1.0009), [1.0011], np.linspace(2, 3, 4000)])
    anchor, want = None, []
    for k, v in enumerate(values):
        if anchor is None or abs(v - anchor) > 0.001:
            anchor = v
            want.append(k)
    assert accepted(values, None, 0.001).tolist() == want


def test_empty(spark, frame):
    none = frame.limit(0)
    assert asof.nearest_before(none, ["asset"], "v", 10 * US, "n").count() == 0
    assert previous_value(none, ["asset"], ["us", "seq"], F.col("v"), "p").count() == 0
    assert running(none, ["asset"], ["us", "seq"], F.col("v"), "t").count() == 0


def test_look_backs_share_sorts(spark, frame):
    """All that looks back sorts a bucket's rows twice, forwards and backwards, in as many partitions as asked for."""
    steps = [asof.nearest("v", {"a": 10 * US, "b": 60 * US}), asof.volatility("v", 600 * US, 60 * US, "vol", history_us=7200 * US)]
    looked = asof.over_time(frame, ["asset"], 7200 * US, steps, {"now": "v"}, parts=7)
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "us#" in line for line in plan.split("\n")) == 2
    assert ", 7), REPARTITION_BY_NUM" in plan and looked.count() == frame.count()


def test_buckets_follow_the_rows(spark):
    """Denser rows get narrower buckets, down to one lookback, and more partitions."""
    day, got = 24 * 3600 * US, []
    for n in (720, 15_000, 72_000):
        df = spark.range(n).select((F.col("id") * 30 * day / n).cast("long").alias("us"), F.lit("a").alias("asset"))
        got.append(bucket_parts(df, ["asset"], day, 1000))
    widths, parts = zip(*got, strict=True)
    assert widths[0] == 4 * day and widths[1] == pytest.approx(2 * day, rel=1e-3) and widths[2] == day
    assert parts[0] == 2 and 45 <= parts[1] <= 46 and parts[2] == 289
    assert bucket_parts(df.limit(0), ["asset"], day) == (4 * day, 1)


def test_entry_reasons_are_dealt_by_rows(spark, tmp_path):
    """What a configuration holds is counted in as many partitions as the rows ask for, not in those that Spark makes of shuffled bytes."""
    columns = [F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 40}').alias("props")]
    spark.range(60_000).select(*columns).write.parquet(f"{tmp_path}/events.parquet")
    plan = signals.entry_reason(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert [len(re.findall(rf"hashpartitioning\(config#\d+, {of}#\d+L?, 4\), REPARTITION_BY_NUM", plan)) for of in ("ticker", "period_id")] == [1, 1]
    assert [row_parts(n) for n in (0, 49_999, 180_000, 18_000_000)] == [1, 1, 4, 361]


def test_ticks_are_dealt_by_rows(spark, tmp_path):
    """More rows than the session's partitions hold well get more partitions; fewer are left to Spark."""
    for n, found in ((60_000, 0), (300_000, 1)):
        columns = [F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 40}').alias("props")]
        spark.range(n).select(*columns).write.parquet(f"{tmp_path}/{n}/events.parquet")
        t = bindings.ticks(spark, f"{tmp_path}/{n}")
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert plan.count(", 7), REPARTITION_BY_NUM") == found and plan.count("Exchange hashpartitioning") == 1 and t.count() == n
