"""Readers, sinks and streams."""

import json

from pyspark.sql import functions as F

from tidemark.sources import snapshots, tables
from tidemark.streaming import market


def test_snapshots(spark):
    replies = [(1, json.dumps({"markets": [{"ticker": "K", "yes_bid": 24, "yes_ask": 26, "volume": 3}]})), (2, json.dumps({"markets": []})), (3, "broken"), (4, None)]
    rows = {r.cycle: r for r in snapshots.market_rows(spark.createDataFrame(replies, "cycle long, payload string")).collect()}
    assert (rows[1].ticker, rows[1].volume, rows[1].oi, rows[1].error) == ("K", 3, 0, None)
    assert all(rows[k].error == "no_market" and rows[k].ticker is None for k in (2, 3, 4))


def test_assembly_drops_failed_cycles(spark):
    markets = spark.createDataFrame([(1, "btc", None), (1, "eth", "e"), (2, "btc", "e")], "cycle long, asset string, error string")
    books = spark.createDataFrame([(1, "btc", 0.5)], "cycle long, asset string, ob_imbalance double")
    prices = spark.createDataFrame([(1, "btc", 9.0)], "cycle long, asset string, price double")
    got = {(r.cycle, r.asset): (r.ob_imbalance, r.price) for r in snapshots.assemble_snapshot(markets, books, prices).collect()}
    assert got == {(1, "btc"): (0.5, 9.0), (1, "eth"): (None, None)}


def test_wide_schema_and_round_trip(spark, tmp_path):
    schema = tables.wide_schema()
    assert len(schema) == 67
    row = {f.name: None for f in schema} | {"ts": "t", "ts_unix": 1.0, "btc_ticker": "K", "btc_mid": 0.5, "eth_mid": float("nan"), "n_valid": 1}
    wide = spark.createDataFrame([tuple(row[n] for n in schema.names)], schema)
    assert tables.export_csv(wide, str(tmp_path / "f.csv"), "ts_unix") == 1
    read = tables.resolve_source(spark, str(tmp_path / "none"), str(tmp_path / "f.csv"))
    first = read.first()
    assert (first.btc_mid, first.eth_mid, first.n_valid) == (0.5, None, 1)
    back = tables.long_rows_to_wide(tables.wide_rows_to_long(read)).first()
    assert back.asDict() == first.asDict()


def test_facts(spark, tmp_path):
    trades = spark.createDataFrame([(1, "A", "YES", 2.0, 0.4), (2, "B", "NO", 1.0, 0.4)], "id long, ticker string, side string, contracts double, price double")
    tables.append_trades(trades, str(tmp_path / "t"))
    tables.append_trades(trades.limit(0), str(tmp_path / "t"))
    settled = spark.createDataFrame([(1, "A", "NO"), (2, "A", "YES")], "id long, ticker string, result string")
    view = tables.settle_trades_view(spark.read.parquet(str(tmp_path / "t")), settled, F.when(F.col("result") == "YES", F.col("contracts") * (1 - F.col("price"))))
    assert {r.id: (r.settled, r.pnl) for r in view.collect()} == {1: ("YES", 1.2), 2: (None, None)}


def test_late_settlements(spark, tmp_path):
    (tmp_path / "r").mkdir(), (tmp_path / "s").mkdir()
    ts = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rolls = spark.createDataFrame([("A", ts(0)), ("B", ts(0)), ("Z", "2026-01-01 03:00:00")], "ticker string, t string").select("ticker", F.col("t").cast("timestamp").alias("roll_ts"))
    done = spark.createDataFrame([("A", ts(300), "YES"), ("B", ts(301), "NO"), ("Z", "2026-01-01 04:00:00", "NO")], "ticker string, t string, result string").select("ticker", F.col("t").cast("timestamp").alias("settle_ts"), "result")
    rolls.write.mode("overwrite").parquet(str(tmp_path / "r")), done.write.mode("overwrite").parquet(str(tmp_path / "s"))
    left, right = (spark.readStream.schema(d.schema).parquet(str(tmp_path / n)) for d, n in ((rolls, "r"), (done, "s")))
    got = {r.ticker: r.result for r in market.run_available(spark, market.settlement_join(left, right), str(tmp_path / "out")).collect()}
    assert got == {"A": "YES", "B": None}


def test_many_sinks(spark, sf_dir, tmp_path):
    stream = market.events_stream(spark, f"{sf_dir}/events.parquet")
    q = market.many_sinks(stream, str(tmp_path / "c"), {"all": (str(tmp_path / "a"), lambda b: b), "some": (str(tmp_path / "b"), lambda b: b.filter("asset = 'view'"))})
    q.awaitTermination()
    everything = spark.read.parquet(str(tmp_path / "a"))
    assert everything.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "b")).count() == everything.filter("asset = 'view'").count()


def test_landed_replies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"markets": [{"ticker": "K", "yes_bid": 24}]}\nbroken\n')
    rows = snapshots.read_landed(spark, str(tmp_path / "in"), snapshots.MARKETS).collect()
    assert sorted((r.markets[0].ticker if r.markets else None, r._corrupt_record) for r in rows if r.markets) == [("K", None)]
    assert [r._corrupt_record for r in rows if not r.markets] == ["broken"]
    stream = snapshots.read_landed(spark, str(tmp_path / "in"), snapshots.MARKETS, stream=True)
    assert stream.isStreaming and market.run_available(spark, stream, str(tmp_path / "out")).count() == 2


def test_sinks(spark, tmp_path):
    long = spark.createDataFrame([(0.0, "btc", 0.5), (86_400.0, "eth", 0.4)], "ts_unix double, asset string, mid double")
    for _ in range(2):
        tables.append_features(long, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 4 and {(str(r.date), r.asset) for r in back.collect()} == {("1970-01-01", "btc"), ("1970-01-02", "eth")}
    rolls = spark.createDataFrame([("t", "btc", "A", "B", 1.0)], tables.TRANSITIONS)
    tables.append_transitions(rolls, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).select("old_ticker", "new_ticker", "asset").first() == ("A", "B", "btc")
    tables.write_predictions(spark.createDataFrame([(0.25, 1, "x")], "prob double, y int, more string"), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).collect() == [("0.25", "1")]
    state = spark.createDataFrame([(1, "btc", 2), (1, "eth", 3)], "k long, asset string, v long")
    made = tables.record_ticks(state, ["k"], "asset", "v", "held")
    assert tables.read_map(made, "held").first().held == {"btc": "2", "eth": "3"}
