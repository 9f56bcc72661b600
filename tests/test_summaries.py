"""Mergeable summaries against plain loops, whatever the buckets; work of lookbacks on one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.ordered import bucket_width
from tidemark.operators.summaries import before_buckets, bucket_summaries, summarised


def plain(rows):
    """rows: (flag, value) in order, flags not null."""
    runs, total, top, low, drop = [], 0.0, 0.0, 0.0, 0.0
    for flag, v in rows:
        if runs and runs[-1][0] == flag:
            runs[-1][1] += 1
        else:
            runs.append([flag, 1])
        total += v or 0.0
        top, low = max(top, total), min(low, total)
        drop = max(drop, top - total)
    longest = lambda f: max([n for flag, n in runs if flag == f], default=0)
    return (*runs[0], *runs[-1], longest(True), longest(False), len(rows)), (total, top, low, drop)


@pytest.mark.parametrize("width", [1, 7, 60, 10_000])
def test_merged_in_any_buckets(spark, width):
    rnd = random.Random(width)
    rows = [(k, a, rnd.choice([True, True, False, None]) if a != "c" else True, None if rnd.random() < 0.1 else rnd.randint(-5, 5) / 4) for a in "abc" for k in range(200)] + [(0, "d", False, -1.0), (1, "e", None, 2.0)]
    df = spark.createDataFrame(rows, "us long, asset string, flag boolean, v double")
    buckets = bucket_summaries(df, ["asset"], ["us"], F.call_function("div", F.col("us"), F.lit(width)), F.col("flag"), F.col("v"))
    got = {r.asset: tuple(r.s) for r in summarised(buckets, ["asset"]).collect()}
    want = {a: [(f, v) for _, x, f, v in rows if x == a and f is not None] for a in "abcd"}
    assert got == {a: sum(plain(x), ()) for a, x in want.items()}
    for r in before_buckets(buckets, ["asset"]).collect():
        earlier = [(f, v) for us, x, f, v in rows if x == r.asset and f is not None and us // width < r._b]
        assert tuple(r.before) == (plain(earlier)[1][:2] if earlier else (0.0, 0.0))
    assert summarised(bucket_summaries(df.limit(0), ["asset"], ["us"], F.lit(0), F.col("flag"), F.col("v")), ["asset"]).count() == 0


def test_lookbacks_use_growing_frames(spark):
    """No frame of a lookback slides: each begins at a bucket's end."""
    df = spark.range(10).select(F.col("id").alias("seq"), F.lit("a").alias("asset"), F.col("id").alias("us"), F.lit(1.0).alias("v"))
    for plan in (asof.realized_volatility(df, ["asset"], "v", 5, 5, "o"), asof.momentum(df, ["asset"], "v", {"m": 4, "n": 8})):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        frames = text.split("specifiedwindowframe(")[1:]
        assert frames and all("unboundedpreceding" in f.split(")")[0] for f in frames)


def test_asof_join_has_no_constant_key(spark):
    rows = spark.range(50).select((F.col("id") * 10).alias("us"), F.col("id").alias("x"))
    states = spark.range(400).select((F.col("id") * 3 + 7).alias("at"), F.col("id").alias("s"))
    got = {r.us: r.s for r in asof.asof_join(rows, states, "at", [], ["s"], 64).collect()}
    assert got == {us: max([k for k in range(400) if k * 3 + 7 <= us], default=None) for us in range(0, 500, 10)}
    assert asof.asof_join(rows, states.limit(0), "at", [], ["s"], 64).filter("s is null").count() == 50


def test_width_from_row_counts(spark):
    """Any width gives the same rows; a denser key makes it narrower."""
    df = spark.range(400).select(F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("asset"), (F.col("id") * 10).alias("us"), (F.col("id") % 17).cast("double").alias("v"))
    width = bucket_width(df, ["asset"], 30)
    assert width == pytest.approx(4000 / 300 * 30, rel=0.02) and bucket_width(df, ["asset"], 30, 10**6) == 10**6 and bucket_width(df.limit(0), ["asset"], 30) > 0
    momenta = [{(r.seq, r.m) for r in asof.momentum(df, ["asset"], "v", {"m": 60}, width_us=w).collect()} for w in (width, 90, 10**9)]
    assert momenta[0] == momenta[1] == momenta[2]
