"""Queries that run a stream over all of events and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir
from ..streaming import market
from .bindings import LONG, ticks_of
from .learning import FEATURES, logistic, samples, score, vectors
from .registry import query
from .signals import feature_vectors
from .ticks import HORIZONS, STALE_MOVE, anchored_sql

#: Conf of the caller's session that a stream's own session takes over.
KEPT = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")


def _run(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Rows of a stream over all events. It runs in a session of its own: its state store is no setting of the caller's."""
    folder, inner = shared_dir(spark), spark.newSession()
    for name in KEPT:
        if (value := spark.conf.get(name, None)) is not None:
            inner.conf.set(name, value)
    # state on disk: one batch may hold all of the table's keys
    inner.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return market.run_available(spark, make(market.events_stream(inner, f"{sf_dir}/events.parquet")), folder)


_E = "WITH e AS (SELECT event_id AS seq, ts, event_type AS asset, 100.0::DOUBLE + value AS price, (SELECT max(ts) - INTERVAL 5 MINUTE FROM events) AS mark FROM events)\n"


@query(_E + "SELECT start, asset, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM e) WHERE start + INTERVAL 6 HOUR <= mark GROUP BY start, asset")
def stream_period_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST3."""
    return _run(spark, sf_dir, market.period_bars).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_E + "SELECT start, asset, round(arg_max(price, (ts, seq)) - arg_min(price, (ts, seq)), 6) AS momentum, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR * k AS start FROM e, (VALUES (0), (1), (2)) s(k)) WHERE start + INTERVAL 6 HOUR <= mark GROUP BY start, asset")
def stream_sliding_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4."""
    return _run(spark, sf_dir, market.sliding_momentum).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_E + "SELECT start, asset, arg_min(seq, (ts, seq)) AS seq, arg_min(price, (ts, seq)) AS price FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM e) WHERE start + INTERVAL 1 HOUR <= mark GROUP BY start, asset")
def stream_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8."""
    return _run(spark, sf_dir, market.throttled).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_E + """, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY asset ORDER BY ts, seq)), s AS (SELECT *, sum(cut) OVER (PARTITION BY asset ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", asset, count(*) AS n FROM s GROUP BY asset, session, mark HAVING max(ts) + INTERVAL 30 MINUTE <= mark""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7."""
    return _run(spark, sf_dir, market.collection_sessions).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_id AS seq, event_type AS asset FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: the stream twice over, each event once."""
    return _run(spark, sf_dir, lambda s: market.deduplicated(s.union(s)).select("seq", "asset"))


_SLOT_US = market.SLOT_SECONDS * 1_000_000
#: Whether the watermark has passed the slot of a time.
_PASSED = f"(({{us}}) // {_SLOT_US} + 1) * {_SLOT_US} <= (SELECT epoch_us(max(mark)) FROM e)"
_R = _E.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", rows AS (SELECT seq, asset, epoch_us(ts) AS us, price FROM e), " + anchored_sql("rows", "asset")


@query(_R + f"SELECT f.asset, f.seq, f.us // {LONG * 1_000_000} AS period, coalesce(f.us // {LONG * 1_000_000} <> lag(f.us // {LONG * 1_000_000}) OVER (PARTITION BY f.asset ORDER BY f.us, f.seq), false) AS rolled, coalesce((f.us - f.since) / 1e6, 999.0) AS stale_seconds FROM folded f WHERE {_PASSED.format(us='f.us')}")
def stream_stateful_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: roll-overs and the anchored price's age from state by asset."""
    return _run(spark, sf_dir, market.stateful_ticks)


STALE_SECONDS = 3600


@query(_R.rstrip() + f", moves AS (SELECT asset, us AS since_us, lead(us) OVER (PARTITION BY asset ORDER BY us, seq) AS next FROM folded WHERE since = us) SELECT asset, since_us, since_us + {STALE_SECONDS * 1_000_000} AS alert_us FROM moves WHERE next - since_us > {STALE_SECONDS * 1_000_000} OR next IS NULL AND since_us + {STALE_SECONDS * 1_000_000} < (SELECT epoch_us(max(mark)) FROM e)")
def stream_stale_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: prices that stood for more than an hour."""
    return _run(spark, sf_dir, lambda s: market.stale_alerts(s, STALE_SECONDS, STALE_MOVE, whole=True))


@query("""WITH e AS (SELECT event_id // 2 AS ticker, event_id % 2 AS part, ts FROM events), marks AS (SELECT least(max(ts) FILTER (WHERE part = 0), max(ts) FILTER (WHERE part = 1)) - INTERVAL 5 MINUTE AS mark FROM e), r AS (SELECT ticker, ts AS roll_ts FROM e WHERE part = 0), s AS (SELECT ticker, ts AS settle_ts FROM e WHERE part = 1)
SELECT CAST(r.ticker AS BIGINT) AS ticker, roll_ts, settle_ts FROM r LEFT JOIN s ON s.ticker = r.ticker AND settle_ts >= roll_ts AND settle_ts <= roll_ts + INTERVAL 300 SECONDS, marks WHERE settle_ts IS NOT NULL OR roll_ts + INTERVAL 300 SECONDS < mark""")
def stream_settlement_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: every second event is a roll-over, the one after it its result, which counts if it comes within 300 seconds."""

    def make(s: DataFrame) -> DataFrame:
        named = s.withColumn("ticker", F.call_function("div", F.col("seq"), F.lit(2)).cast("long")).withColumn("result", F.lit("YES"))
        rolls = named.filter("seq % 2 = 0").select("ticker", F.col("ts").alias("roll_ts"))
        return market.settlement_join(rolls, named.filter("seq % 2 = 1").select("ticker", F.col("ts").alias("settle_ts"), "result")).drop("result")

    return _run(spark, sf_dir, make).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("roll_ts", "settle_ts")})


#: How far back a feature looks: one and a half of the longest horizon, and the hour whose leader it may take.
LOOKBACK_US = (3 * max(HORIZONS) // 2 + 3600) * 1_000_000


def streamed_scores(stream: DataFrame, model: PipelineModel, folder: str, delay_us: int = 300_000_000) -> DataFrame:
    """ST11: raw events, once their slot has closed, with the fourteen features and the prob of a fitted model.

    The same functions as in batch see a slot's rows, a lookback before them and
    each asset's last quoted row. A leader silent for longer than the lookback
    has a mid, but no momentum.
    """

    def make(known: DataFrame) -> DataFrame:
        t = feature_vectors(ticks_of(known.drop("us", "seq")))
        return score(model, vectors(t.select("seq", "asset", "us", *FEATURES))).select("seq", "asset", "us", *FEATURES, "prob")

    raw = stream.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "seq": F.col("event_id")})
    quoted = "cast(get_json_object(props, '$.k') as int) > 0"
    return market.SlotBatches(folder, make, "event_type", quoted, LONG * 1_000_000, LOOKBACK_US, delay_us).run_available(raw)


@query()
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: the stream of events scored by a model of all features that is fitted on the settled contracts."""
    rows = samples(spark, sf_dir)
    model = logistic(rows.count()).fit(rows)
    made = streamed_scores(market.raw_stream(spark, f"{sf_dir}/events.parquet"), model, f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}")
    return made.select("seq", "asset", "prob")
