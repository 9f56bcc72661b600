"""Streams over many files that are not in the order of event time."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.operators.folds import anchored_stale_seconds
from tidemark.operators.ordered import previous_value
from tidemark.plans import learning, streams
from tidemark.streaming import market


def test_many_files_out_of_order(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    split = tmp_path / "many"
    parts = 24
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    (split / "events.parquet").mkdir(parents=True)
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * parts / (high - low)), F.lit(parts - 1))
    for k in range(parts):
        events.filter(part == k).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (file,) = (tmp_path / f"p{k}").glob("*.parquet")
        to = split / "events.parquet" / f"{k:02}.parquet"
        file.rename(to)
        os.utime(to, (1_700_000_000 - 60 * k,) * 2)  # later events landed first
    for name in ("stream_deduplicated", "stream_period_bars", "stream_sliding_momentum", "stream_throttled", "stream_sessions", "stream_stateful_ticks", "stream_stale_alerts"):
        got, want = (plans.QUERIES[name](spark, d) for d in (str(split), sf_dir))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


@pytest.fixture
def unordered(spark, sf_dir, tmp_path):
    """Events dealt to 24 files by hash, so that each spans all of the time, and a last file long after them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = tmp_path / "unordered"
    folder.mkdir()
    late = events.orderBy("ts").limit(1).withColumns({"ts": F.expr("ts + INTERVAL 200 DAYS"), "event_type": F.lit("sentinel"), "event_id": F.lit(-1).cast("long")})
    for k in range(25):
        rows = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(24)) == k) if k < 24 else late
        rows.coalesce(1).write.parquet(str(tmp_path / f"u{k}"))
        (file,) = (tmp_path / f"u{k}").glob("*.parquet")
        to = folder / f"{k:02}.parquet"
        file.rename(to)
        os.utime(to, (1_700_000_000 + 60 * k,) * 2)
    return str(folder)


def replayed(spark, folder, tmp_path, make):
    inner = spark.newSession()
    inner.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    inner.conf.set("spark.sql.shuffle.partitions", "3")
    return market.run_available(spark, make(market.events_stream(inner, folder, files_per_batch=6)), f"file://{tmp_path}/out").collect()


def test_state_by_slot_over_batches_in_any_order(spark, sf_dir, unordered, tmp_path):
    """Files of any order over many batches give what one batch over all rows gives."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("asset"), (F.lit(100.0) + F.col("value")).alias("price"))
    batch = anchored_stale_seconds(rows, ["asset"], "price", 0.5)
    batch = previous_value(batch.withColumn("period", F.call_function("div", F.col("us"), F.lit(21_600_000_000))), ["asset"], ["us", "seq"], F.col("period"), "before")
    want = {r.seq: (r.asset, r.period, r.before is not None and r.before != r.period, r.stale_seconds) for r in batch.collect()}
    got = replayed(spark, unordered, tmp_path, lambda s: market.stateful_ticks(s, threshold=0.5, slot_seconds=7200, delay="60 days"))
    assert {r.seq: (r.asset, r.period, r.rolled, r.stale_seconds) for r in got} == want and len(got) == len(want)
    limit, moves = 3600, {}
    for r in sorted(batch.collect(), key=lambda r: (r.us, r.seq)):
        if r.stale_seconds == 0:
            moves.setdefault(r.asset, []).append(r.us)
    stale = {(a, t) for a, times in moves.items() for t, after in zip(times, [*times[1:], None], strict=True) if after is None or after - t > limit * 10**6}
    got = replayed(spark, unordered, tmp_path, lambda s: market.stale_alerts(s, limit, 0.5, slot_seconds=7200, delay="60 days"))
    assert {(r.asset, r.since_us) for r in got} == stale and len(got) == len(stale)


@pytest.mark.parametrize("ordered", [True, False])
def test_scores_over_batches(spark, sf_dir, unordered, tmp_path, ordered):
    """Features that look over slots and batches, the leader's among them: each row as the batch operators give it."""
    rows = learning.samples(spark, sf_dir)
    model = learning.logistic(rows.count()).fit(rows)
    if ordered:  # slots close batch by batch
        events, folder = spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(8, "ts").sortWithinPartitions("ts"), tmp_path / "ordered"
        folder.mkdir()
        for k in range(8):
            events.filter(F.spark_partition_id() == k).coalesce(1).write.parquet(str(tmp_path / f"o{k}"))
            (file,) = (tmp_path / f"o{k}").glob("*.parquet")
            file.rename(folder / f"{k}.parquet")
            os.utime(folder / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    stream = market.raw_stream(spark, str(folder) if ordered else unordered, files_per_batch=2 if ordered else 9)
    got = streams.streamed_scores(stream, model, f"file://{tmp_path}/scores", 300_000_000 if ordered else 60 * 86_400_000_000).filter("seq >= 0").collect()
    top = max(r.us for r in got)
    want = {r.seq: r for r in learning.score(model, rows).filter(F.col("us") <= top).collect()}
    assert len(got) == len(want) > 900
    for r in got:
        assert all(r[c] == pytest.approx(want[r.seq][c]) for c in [*learning.FEATURES, "prob"]), r


def test_alerts_of_the_last_slot(spark, tmp_path):
    """Prices that stood too long are told of up to the last row, not only in slots that the watermark has passed."""
    at = lambda minutes: f"timestamp_ntz '2024-01-01 00:00:00' + INTERVAL {minutes} MINUTES"
    moves = [("a", 10, 1.0), ("a", 20, 2.0), ("a", 90, 3.0), ("a", 170, 4.0), ("b", 30, 1.0), ("b", 40, 1.0), ("c", 100, 1.0), ("c", 177, 2.0)]
    events = " UNION ALL ".join(f"SELECT cast({k} as long) AS event_id, {at(m)} AS ts, cast(1 as long) AS user_id, '{a}' AS event_type, cast({v} as double) AS value, '{{\"k\": 5}}' AS props" for k, (a, m, v) in enumerate(moves))
    spark.sql(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = plans.QUERIES["stream_stale_alerts"](spark, str(tmp_path)).collect()
    start = 1_704_067_200
    assert sorted((r.asset, (r.since_us // 10**6 - start) // 60, (r.alert_us - r.since_us) // 10**6) for r in got) == [("a", 20, 3600), ("a", 90, 3600), ("b", 30, 3600), ("c", 100, 3600)]
