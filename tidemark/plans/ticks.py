"""Queries over ticks: quotes, features, quality, windows and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof
from ..operators.folds import anchored_stale_seconds
from ..operators.ordered import DAY_US, previous_value, running
from ..sources.staging import staged
from ..sources.tables import ASSET_COLUMNS
from .bindings import LONG, SHORT, settled, settled_sql, settlements, ticks, ticks_sql
from .registry import query

HORIZONS = (900, 1800, 3600)
GAP_SECONDS = 600
BLOCK = 4096
_MICRO = 1_000_000


@query(ticks_sql(SHORT) + "SELECT seq, asset, us, ticker, mid, spread, pvs, tte, floor_strike, ob_imbalance FROM ticks")
def canonical_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, spread, strike distance and book imbalance of every tick."""
    return ticks(spark, sf_dir, SHORT).select("seq", "asset", "us", "ticker", "mid", "spread", "pvs", "tte", "floor_strike", "ob_imbalance")


@query("""WITH b AS (SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id FROM events)
SELECT seq, CASE WHEN k % 7 <> 0 THEN k END AS yes_bid, CASE WHEN k % 7 <> 0 THEN k + 1 + CAST(user_id % 5 AS INTEGER) END AS yes_ask, CASE WHEN k % 7 <> 0 THEN user_id ELSE 0 END AS volume, CAST(0 AS BIGINT) AS oi,
CASE WHEN k % 7 <> 0 THEN 'active' END AS status, CASE WHEN k % 7 = 0 THEN 'no_market' END AS error FROM b""")
def market_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON replies, built from events, read with their schema; an empty market list is an error row."""
    from ..sources.snapshots import market_rows

    k = F.get_json_object("props", "$.k").cast("int")
    market = F.struct(F.concat(F.lit("KX"), F.upper("event_type")).alias("ticker"), F.lit("active").alias("status"), k.alias("yes_bid"), (k + 1 + (F.col("user_id") % 5).cast("int")).alias("yes_ask"), F.col("user_id").alias("volume"))
    markets = F.when(k % 7 != 0, F.array(market)).otherwise(F.filter(F.array(market), lambda _: F.lit(False)))
    replies = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.to_json(F.struct(markets.alias("markets"))).alias("payload"))
    return market_rows(replies).select("seq", "yes_bid", "yes_ask", "volume", "oi", "status", "error")


@query("""WITH b AS (SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER)::DOUBLE AS k, (user_id % 40)::DOUBLE AS u FROM events)
SELECT seq, round((k + u - u) / nullif(k + u + u, 0), 4) AS ob_imbalance, k + u AS yes_depth, u AS no_depth, 100 - (CASE WHEN u > 0 THEN u ELSE 1 END) AS yes_ask, 100 - k AS no_ask FROM b""")
def orderbook_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON orderbooks read with their schema; depth, imbalance and asks from the other side."""
    from ..sources.snapshots import book_rows

    k, u = F.get_json_object("props", "$.k").cast("double"), (F.col("user_id") % 40).cast("double")
    one = F.when(u > 0, u).otherwise(1.0)
    book = F.struct(F.array(F.array(k, k), F.array(k - 1, u)).alias("yes"), F.array(F.array(one, u)).alias("no"))
    replies = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.to_json(F.struct(book.alias("orderbook"))).alias("payload"))
    return book_rows(replies).select("seq", "ob_imbalance", "yes_depth", "no_depth", "yes_ask", "no_ask")


@query("SELECT event_id AS seq, event_type AS asset, round(1 / nullif(value, 0), 4) AS price FROM events WHERE event_type IN ('click', 'error', 'purchase')")
def reference_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of rates, exploded to the wanted symbols and inverted."""
    from ..sources.snapshots import rate_rows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    replies = events.select(F.col("event_id").alias("seq"), F.to_json(F.struct(F.create_map(F.col("event_type"), F.col("value").cast("string")).alias("rates"))).alias("payload"))
    return rate_rows(replies, ["click", "error", "purchase"]).select("seq", "asset", "price")


@query(ticks_sql(SHORT) + """SELECT seq, CASE WHEN mid > 0.55 THEN 'up' WHEN mid < 0.45 THEN 'down' ELSE 'flat' END AS mid_band, CASE WHEN pvs > 0 THEN 'above' WHEN pvs < 0 THEN 'below' ELSE 'at' END AS pvs_band,
CASE WHEN ob_imbalance > 0.1 THEN 'bid' WHEN ob_imbalance < -0.1 THEN 'offer' ELSE 'even' END AS book_band, CASE WHEN tte < 120 THEN 'closing' WHEN tte < 300 THEN 'late' ELSE 'early' END AS tte_band,
strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || printf('.%03dZ', (us // 1000) % 1000) AS iso, us / 1e6 AS epoch, strftime(make_timestamp(us), '%H:%M:%S') AS time_of_day, tte / 900 AS tte_pct, abs(mid - 0.5) AS mid_decisiveness, printf('%d:%02d', CAST(floor(tte / 60) AS BIGINT), CAST(floor(tte % 60) AS BIGINT)) AS clock, substr(ticker, 1, 8) AS short_ticker FROM ticks""")
def display_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, clock text, shares of the period."""
    t = ticks(spark, sf_dir, SHORT)
    made = S.bands(F.col("mid"), F.col("pvs"), F.col("ob_imbalance"), F.col("tte"))
    at = F.timestamp_micros(F.col("us"))
    times = [F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), (F.col("us") / 1e6).alias("epoch"), F.date_format(at, "HH:mm:ss").alias("time_of_day")]
    return t.select("seq", *[c.alias(n) for n, c in made.items()], *times, (F.col("tte") / 900).alias("tte_pct"), F.abs(F.col("mid") - 0.5).alias("mid_decisiveness"), S.minutes_seconds(F.col("tte")).alias("clock"), F.substring("ticker", 1, 8).alias("short_ticker"))


@query(ticks_sql(SHORT) + "SELECT DISTINCT asset, ticker, split_part(ticker, '-', 1) AS series, split_part(ticker, '-', 2) AS time_key, split_part(ticker, '-', 2) || '-' || split_part(ticker, '-', 3) AS period_key FROM ticks")
def parsed_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tickers and their parts."""
    t = ticks(spark, sf_dir, SHORT).select("asset", "ticker").distinct()
    return t.select("asset", "ticker", *[S.ticker_part(F.col("ticker"), p).alias(p) for p in ("series", "time_key", "period_key")])


@query(ticks_sql(SHORT) + "SELECT ticker, min(asset) AS asset, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows FROM ticks GROUP BY ticker")
def enumerate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with their span."""
    return ticks(spark, sf_dir, SHORT).groupBy("ticker").agg(F.min("asset").alias("asset"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_rows"))


@query(ticks_sql(SHORT) + "SELECT count(*) AS n_rows, (max(us) - min(us)) / 1e6 AS span_seconds, (max(us) - min(us)) // 900000000 AS cycles, count(DISTINCT ticker) AS n_tickers FROM ticks")
def time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, S10."""
    width = F.max("us") - F.min("us")
    return ticks(spark, sf_dir, SHORT).agg(F.count("*").alias("n_rows"), (width / 1e6).alias("span_seconds"), F.call_function("div", width, F.lit(900_000_000)).alias("cycles"), F.countDistinct("ticker").alias("n_tickers"))


def gaps(t: DataFrame, seconds: float = GAP_SECONDS) -> DataFrame:
    """Ticks of an asset that come later than so many seconds after the one before."""
    seen = previous_value(t, ["asset"], ["us", "seq"], F.col("us"), "before_us")
    return seen.withColumn("gap", (F.col("us") - F.col("before_us")) / 1e6).filter(F.col("gap") > seconds)


_GAPS = ticks_sql(SHORT) + f", gaps AS (SELECT * FROM (SELECT seq, asset, us, lag(us) OVER (PARTITION BY asset ORDER BY us, seq) AS before_us, (us - lag(us) OVER (PARTITION BY asset ORDER BY us, seq)) / 1e6 AS gap FROM ticks) WHERE gap > {GAP_SECONDS})\n"


@query(_GAPS + "SELECT seq, asset, us, before_us, gap FROM gaps")
def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(ticks(spark, sf_dir, SHORT)).select("seq", "asset", "us", "before_us", "gap")


@query(_GAPS + "SELECT s.asset, coalesce(g.n, 0) AS n_gaps, round(coalesce(g.total, 0), 3) AS gap_seconds, round(coalesce(g.total, 0) / s.span * 100, 6) AS gap_pct FROM (SELECT asset, (max(us) - min(us)) / 1e6 AS span FROM ticks GROUP BY asset) s LEFT JOIN (SELECT asset, count(*) AS n, sum(gap) AS total FROM gaps GROUP BY asset) g USING (asset)")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: gaps and their share of the span."""
    t = ticks(spark, sf_dir, SHORT)
    seen = previous_value(t, ["asset"], ["us", "seq"], F.col("us"), "before_us").withColumn("gap", (F.col("us") - F.col("before_us")) / 1e6)
    long_gap = F.when(F.col("gap") > GAP_SECONDS, F.col("gap"))
    out = seen.groupBy("asset").agg(F.count(long_gap).alias("n_gaps"), F.round(F.coalesce(F.sum(long_gap), F.lit(0.0)), 3).alias("gap_seconds"), ((F.max("us") - F.min("us")) / 1e6).alias("span"))
    return out.select("asset", "n_gaps", "gap_seconds", F.round(F.col("gap_seconds") / F.col("span") * 100, 6).alias("gap_pct"))


@query(_GAPS + "SELECT asset, us, gap FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY us, seq) AS r FROM gaps) WHERE r <= 5")
def first_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five gaps of each asset."""
    rank = F.row_number().over(Window.partitionBy("asset").orderBy("us", "seq"))
    return gaps(ticks(spark, sf_dir, SHORT)).withColumn("r", rank).filter("r <= 5").select("asset", "us", "gap")


@query(ticks_sql(SHORT) + "SELECT * FROM (SELECT asset, us, lag(ticker) OVER (PARTITION BY asset ORDER BY us, seq) AS old_ticker, ticker AS new_ticker, floor_strike AS new_floor_strike FROM ticks) WHERE old_ticker <> new_ticker")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-overs to another contract; missing tickers are passed over."""
    t = ticks(spark, sf_dir, SHORT)
    named = t.filter(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    seen = previous_value(named, ["asset"], ["us", "seq"], F.col("ticker"), "old_ticker").filter("old_ticker <> ticker")
    return seen.select("asset", "us", "old_ticker", F.col("ticker").alias("new_ticker"), F.col("floor_strike").alias("new_floor_strike"))


@query(ticks_sql(SHORT) + "SELECT asset, count(*) AS n_rows, count(yes_bid) AS n_bid, count(yes_ask) AS n_ask, count(mid) AS n_mid, count(spread) AS n_spread, count(pvs) AS n_pvs, count(ob_imbalance) AS n_book, count(*) - count(mid) AS n_error FROM ticks GROUP BY asset")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: non-null counts by asset."""
    cols = {"n_bid": "yes_bid", "n_ask": "yes_ask", "n_mid": "mid", "n_spread": "spread", "n_pvs": "pvs", "n_book": "ob_imbalance"}
    return ticks(spark, sf_dir, SHORT).groupBy("asset").agg(F.count("*").alias("n_rows"), *[F.count(c).alias(n) for n, c in cols.items()], (F.count("*") - F.count("mid")).alias("n_error"))


#: The edges of the histogram in seconds.
TTE_EDGES = [0.0, 60.0, 180.0, 300.0, 450.0, 600.0, 750.0, 900.0]
TTE_LABELS = [f"{a / 60:g}-{b / 60:g}m" for a, b in zip(TTE_EDGES[:-1], TTE_EDGES[1:], strict=True)]
_BIN = "CASE " + " ".join(f"WHEN tte >= {a} AND (tte < {b}{' OR tte = 900' if b == 900 else ''}) THEN '{n}'" for a, b, n in zip(TTE_EDGES[:-1], TTE_EDGES[1:], TTE_LABELS, strict=True)) + " END"


@query(ticks_sql(SHORT) + f"SELECT b.bin, count(t.bin) AS n FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in TTE_LABELS)}) b(bin) LEFT JOIN (SELECT {_BIN} AS bin FROM ticks) t USING (bin) GROUP BY b.bin")
def tte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: last bin closed, out of range dropped, empty bins kept."""
    counts = ticks(spark, sf_dir, SHORT).select(S.binned(F.col("tte"), TTE_EDGES, TTE_LABELS).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    labels = spark.createDataFrame([(x,) for x in TTE_LABELS], "bin string")
    return labels.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(ticks_sql(SHORT) + "SELECT asset, min(tte) AS least, max(tte) AS most, round(avg(tte), 6) AS mean, round(stddev_samp(tte), 6) AS std FROM ticks GROUP BY asset")
def tte_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: spread of the time to expiry."""
    return ticks(spark, sf_dir, SHORT).groupBy("asset").agg(F.min("tte").alias("least"), F.max("tte").alias("most"), F.round(F.avg("tte"), 6).alias("mean"), F.round(F.stddev_samp("tte"), 6).alias("std"))


@query(ticks_sql(SHORT) + "SELECT asset, ticker, n FROM (SELECT asset, ticker, count(*) AS n, row_number() OVER (PARTITION BY asset ORDER BY min(us), ticker) AS r FROM ticks GROUP BY asset, ticker) WHERE r <= 8")
def ticker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: rows of the first eight tickers of each asset."""
    counts = ticks(spark, sf_dir, SHORT).groupBy("asset", "ticker").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))
    rank = F.row_number().over(Window.partitionBy("asset").orderBy("first_us", "ticker"))
    return counts.withColumn("r", rank).filter("r <= 8").select("asset", "ticker", "n")


@query(ticks_sql(SHORT) + " UNION ALL ".join(f"SELECT asset, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS least, max({c}) AS most FROM ticks GROUP BY asset" for c in ("ob_imbalance", "pvs", "mid")))
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over long (feature, value) rows."""
    t = ticks(spark, sf_dir, SHORT)
    long = t.select("asset", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in ("ob_imbalance", "pvs", "mid")])).alias("x")).select("asset", "x.*")
    return long.groupBy("asset", "feature").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def nearest_sql(value: str, horizon: int, inclusive: bool = True) -> str:
    """(asset, us, v): the value nearest to us - horizon; for rows of table ticks."""
    h = horizon * _MICRO
    tol = h // 2 if inclusive else (h - 1) // 2
    return f"""(SELECT a.asset, a.us, arg_min(p.v, (abs(a.us - {h} - p.us), p.us)) AS v FROM (SELECT DISTINCT asset, us FROM ticks) a JOIN (SELECT asset, us, arg_min({value}, seq) AS v FROM ticks WHERE {value} IS NOT NULL GROUP BY asset, us) p
 ON a.asset = p.asset AND p.us BETWEEN a.us - {h + tol} AND a.us - {h - tol} GROUP BY a.asset, a.us)"""


_NOW = "last_value({c} IGNORE NULLS) OVER (PARTITION BY asset ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(ticks_sql() + ", now AS (SELECT seq, asset, us, " + _NOW.format(c="mid") + " AS cur FROM ticks) SELECT seq, asset" + "".join(f", round(cur - m{h}.v, 6) AS mom_{h}" for h in HORIZONS) + " FROM now" + "".join(f" LEFT JOIN {nearest_sql('mid', h)} m{h} USING (asset, us)" for h in HORIZONS))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the mid nearest to a horizon ago, three horizons."""
    t = ticks(spark, sf_dir).select("seq", "asset", "us", "mid")
    t = asof.momentum(t, ["asset"], "mid", {f"mom_{h}": h * _MICRO for h in HORIZONS})
    return t.select("seq", "asset", *[f"mom_{h}" for h in HORIZONS])


@query(ticks_sql() + ", now AS (SELECT seq, asset, us, " + _NOW.format(c="real_price") + " AS cur FROM ticks) SELECT seq, asset" + "".join(f", round(CASE WHEN m{h}.v > 0 THEN (cur - m{h}.v) / m{h}.v * 100 END, 6) AS trend_{h}" for h in (900, 1800)) + " FROM now" + "".join(f" LEFT JOIN {nearest_sql('real_price', h, False)} m{h} USING (asset, us)" for h in (900, 1800)))
def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent change against the price a window ago, strict tolerance."""
    t = ticks(spark, sf_dir).select("seq", "asset", "us", "real_price")
    t = asof.trend(t, ["asset"], "real_price", {f"trend_{h}": h * _MICRO for h in (900, 1800)})
    return t.select("seq", "asset", *[F.round(f"trend_{h}", 6).alias(f"trend_{h}") for h in (900, 1800)])


@query(ticks_sql() + ", now AS (SELECT seq, asset, us, " + _NOW.format(c="mid") + " AS cur, count(mid) OVER (PARTITION BY asset ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n FROM ticks) SELECT seq, asset, CASE WHEN n >= 5 THEN round(cur - m.v, 6) END AS mid_dir FROM now LEFT JOIN " + nearest_sql("mid", 1800, False) + " m USING (asset, us)")
def mid_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the mid, if at least five points lie in the last window."""
    t = ticks(spark, sf_dir).select("seq", "asset", "us", "mid")
    window, horizon = LONG * _MICRO, 1800 * _MICRO
    counted = asof.Step({"n": F.col("_n")}, until=lambda by: {"_n": asof.within(F.col("mid").isNotNull().cast("int"), window, by)})
    looked = asof.over_time(t, ["asset"], window, [counted, asof.nearest("mid", {"then": horizon}, inclusive=False)], {"now": "mid"})
    return looked.select("seq", "asset", F.when(F.col("n") >= 5, F.round(F.col("now") - F.col("then"), 6)).alias("mid_dir"))


@query(ticks_sql(SHORT) + "SELECT asset, count(*) AS n" + "".join(f", count(m{h}.v) AS n_{h}, round(count(m{h}.v) / count(*) * 100, 6) AS pct_{h}" for h in HORIZONS) + " FROM ticks" + "".join(f" LEFT JOIN {nearest_sql('mid', h)} m{h} USING (asset, us)" for h in HORIZONS) + " GROUP BY asset")
def momentum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ticks have a neighbour at each horizon."""
    t = ticks(spark, sf_dir, SHORT).select("seq", "asset", "us", "mid")
    t = asof.over_time(t, ["asset"], asof.lookback(max(HORIZONS) * _MICRO), [asof.nearest("mid", {f"v_{h}": h * _MICRO for h in HORIZONS})])
    return t.groupBy("asset").agg(F.count("*").alias("n"), *[x for h in HORIZONS for x in (F.count(f"v_{h}").alias(f"n_{h}"), F.round(F.count(f"v_{h}") / F.count("*") * 100, 6).alias(f"pct_{h}"))])


VOL_WINDOW = 21_600
VOL_HISTORY = 4 * VOL_WINDOW
#: The least prices of the history, prices of the window, and returns.
VOL_LEAST = (20, 15, 10)
_VOL = f"""r AS (SELECT seq, asset, us, real_price, CASE WHEN lag(real_price) OVER w > 0 THEN (real_price - lag(real_price) OVER w) / lag(real_price) OVER w * 100 END AS r, lag(us) OVER w AS before_us FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY us, seq)),
v AS (SELECT a.seq, count(b.real_price) AS n_held, count(b.real_price) FILTER (b.us > a.us - {VOL_WINDOW * _MICRO}) AS n_recent, count(b.r) FILTER (b.before_us > a.us - {VOL_WINDOW * _MICRO}) AS n, stddev_pop(b.r) FILTER (b.before_us > a.us - {VOL_WINDOW * _MICRO}) AS sd
 FROM r a LEFT JOIN r b ON a.asset = b.asset AND b.us <= a.us AND b.us > a.us - {VOL_HISTORY * _MICRO} GROUP BY a.seq)"""
VOL_SQL = f"CASE WHEN n_held >= {VOL_LEAST[0]} AND n_recent >= {VOL_LEAST[1]} AND n >= {VOL_LEAST[2]} THEN sd * sqrt(n * ({SHORT} / {VOL_WINDOW}::DOUBLE)) END"


def tick_volatility(name: str = "vol") -> asof.Step:
    return asof.volatility("real_price", VOL_WINDOW * _MICRO, SHORT * _MICRO, name, VOL_LEAST, VOL_HISTORY * _MICRO)


@query(ticks_sql() + f", {_VOL} SELECT seq, round({VOL_SQL}, 6) AS vol FROM v")
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of returns within the window, scaled to a period."""
    t = ticks(spark, sf_dir).select("seq", "asset", "us", "real_price")
    return asof.over_time(t, ["asset"], VOL_HISTORY * _MICRO, [tick_volatility()]).select("seq", F.round("vol", 6).alias("vol"))


@query(ticks_sql() + """, d AS (SELECT seq, asset, us, CASE WHEN abs(real_price - lag(real_price) OVER (PARTITION BY asset ORDER BY us, seq)) > 0.001 THEN us END AS moved FROM ticks)
SELECT seq, asset, coalesce((us - last_value(moved IGNORE NULLS) OVER (PARTITION BY asset ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1e6, 999.0) AS stale_seconds FROM d""")
def price_stale_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, approximate: seconds since the price last moved from one tick to the next; 999 if never."""
    t = previous_value(ticks(spark, sf_dir), ["asset"], ["us", "seq"], F.col("real_price"), "before")
    t = t.withColumn("moved", F.when(F.abs(F.col("real_price") - F.col("before")) > 0.001, F.col("us")))
    t = previous_value(t, ["asset"], ["us", "seq"], F.col("moved"), "last_moved")
    return t.select("seq", "asset", F.coalesce((F.col("us") - F.coalesce("moved", "last_moved")) / 1e6, F.lit(999.0)).alias("stale_seconds"))


STALE_MOVE = 0.001


def anchored_sql(source: str, keys: str, move: float = 0.001) -> str:
    """A fold over source (seq, us, price and keys): the last accepted price (anchor) and its time (since) after each row."""
    near = " AND ".join(f"n.{k} = f.{k}" for k in keys.split(", "))
    mine = ", ".join(f"n.{k}" for k in keys.split(", "))
    moves = f"n.price IS NOT NULL AND (f.anchor IS NULL OR abs(n.price - f.anchor) > {move}::DOUBLE)"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us, seq) AS r FROM {source}),
folded AS (SELECT {keys}, r, seq, us, price AS anchor, CASE WHEN price IS NOT NULL THEN us END AS since FROM numbered WHERE r = 1
 UNION ALL SELECT {mine}, n.r, n.seq, n.us, CASE WHEN {moves} THEN n.price ELSE f.anchor END, CASE WHEN {moves} THEN n.us ELSE f.since END FROM folded f JOIN numbered n ON {near} AND n.r = f.r + 1)
"""


@query(ticks_sql().replace("WITH ", "WITH RECURSIVE ", 1) + ", rows AS (SELECT seq, asset, us, real_price AS price FROM ticks), " + anchored_sql("rows", "asset", STALE_MOVE) + "SELECT seq, asset, coalesce((us - since) / 1e6, 999.0) AS stale_seconds FROM folded")
def price_stale_sec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, exact: the clock restarts only when the price has moved from the last accepted price, over all of an asset's ticks."""
    t = ticks(spark, sf_dir).select("seq", "asset", "us", "real_price")
    return anchored_stale_seconds(t, ["asset"], "real_price", STALE_MOVE).select("seq", "asset", "stale_seconds")


SLOT_US = 300 * _MICRO


@query(ticks_sql(SHORT) + f""", g AS (SELECT *, (us - lag(us) OVER (PARTITION BY asset ORDER BY us, seq)) / 1e6 AS gap FROM ticks), span AS (SELECT min(us) AS a, max(us) AS b FROM ticks)
SELECT us // {SLOT_US} AS slot, asset, count(*) AS n, count(mid) AS n_valid, bool_or(mid IS NULL) AS any_error, round(avg(mid), 6) AS mean_mid, count(*) FILTER (WHERE gap > {GAP_SECONDS}) AS n_gaps, round(coalesce(sum(gap) FILTER (WHERE gap > {GAP_SECONDS}), 0), 3) AS gap_seconds,
round(least(100.0, ((us // {SLOT_US} + 1) * {SLOT_US} - any_value(a)) / (any_value(b) - any_value(a))::DOUBLE * 100), 6) AS pct_elapsed FROM g, span GROUP BY us // {SLOT_US}, asset""")
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, valid rows, gaps and the share of the run that has passed, in slots of 300 seconds."""
    t = ticks(spark, sf_dir, SHORT)
    seen = previous_value(t, ["asset"], ["us", "seq"], F.col("us"), "before_us").withColumn("slot", F.call_function("div", F.col("us"), F.lit(SLOT_US)))
    gap = (F.col("us") - F.col("before_us")) / 1e6
    wide = F.when(gap > GAP_SECONDS, gap)
    span = t.agg(F.min("us").alias("a"), F.max("us").alias("b"))
    by = seen.groupBy("slot", "asset").agg(F.count("*").alias("n"), F.count("mid").alias("n_valid"), F.bool_or(F.col("mid").isNull()).alias("any_error"), F.round(F.avg("mid"), 6).alias("mean_mid"), F.count(wide).alias("n_gaps"), F.round(F.coalesce(F.sum(wide), F.lit(0.0)), 3).alias("gap_seconds"))
    elapsed = F.least(F.lit(100.0), ((F.col("slot") + 1) * SLOT_US - F.col("a")) / (F.col("b") - F.col("a")) * 100)
    return by.join(F.broadcast(span)).withColumn("pct_elapsed", F.round(elapsed, 6)).drop("a", "b")  # one row is sent


@query(ticks_sql(SHORT) + f"SELECT asset, count(*) AS polls, count(DISTINCT us // {SLOT_US}) AS cycles, count(DISTINCT CASE WHEN mid IS NULL THEN us // {SLOT_US} END) AS cycles_with_error FROM ticks GROUP BY asset")
def poll_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls, and cycles with any error."""
    cycle = F.call_function("div", F.col("us"), F.lit(SLOT_US))
    by = ticks(spark, sf_dir, SHORT).groupBy("asset", cycle.alias("cycle")).agg(F.count("*").alias("n"), F.bool_or(F.col("mid").isNull()).alias("bad"))
    return by.groupBy("asset").agg(F.sum("n").alias("polls"), F.count("*").alias("cycles"), F.count_if("bad").alias("cycles_with_error"))


#: The limits of the verdict: rows, seconds, share of gaps (issue, warning), shares of mids and prices, seconds to expiry, contracts, settled ones.
LEAST_ROWS, LEAST_SPAN, MOST_GAPS, SOME_GAPS, LEAST_MIDS, LEAST_PRICES, LEAST_TTE, LEAST_TICKERS, LEAST_SETTLED = 1500, 3600, 10.0, 5.0, 0.9, 0.5, 600, 8, 4
_ISSUES = {"rows": f"n < {LEAST_ROWS}", "span": f"span < {LEAST_SPAN}", "gaps": f"gap_pct > {MOST_GAPS}"}
_WARNINGS = {"gaps": f"gap_pct > {SOME_GAPS} AND gap_pct <= {MOST_GAPS}", "price": f"price_share < {LEAST_PRICES}", "tte": f"tte_max < {LEAST_TTE}", "tickers": f"tickers < {LEAST_TICKERS}", "settled": f"settled < {LEAST_SETTLED}"}


def _listed(checks: dict[str, str]) -> str:
    return "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()) + "] IF x IS NOT NULL], ',')"


def _mid_checks() -> dict[str, str]:
    return {f"mid {a}": f"mids_{a} < {LEAST_MIDS}" for a in ASSETS}


ASSETS = ["click", "error", "purchase", "signup", "view"]


@query(ticks_sql(SHORT) + f""", g AS (SELECT *, (us - lag(us) OVER (ORDER BY us, seq)) / 1e6 AS gap FROM ticks), m AS (SELECT count(*) AS n, (max(us) - min(us)) / 1e6 AS span, coalesce(sum(gap) FILTER (WHERE gap > {GAP_SECONDS}), 0) AS gap_seconds, count(pvs) / count(*) AS price_share, max(tte) AS tte_max, count(DISTINCT ticker) AS tickers,
count(DISTINCT CASE WHEN us < (SELECT max(period_id) FROM ticks) * {SHORT * _MICRO} THEN ticker END) AS settled, {", ".join(f"count(CASE WHEN asset = '{a}' THEN mid END) / nullif(count(CASE WHEN asset = '{a}' THEN 1 END), 0)::DOUBLE AS mids_{a}" for a in ASSETS)} FROM g), q AS (SELECT *, gap_seconds / nullif(span, 0) * 100 AS gap_pct FROM m)
SELECT n, round(gap_pct, 6) AS gap_pct, CASE WHEN n >= 5400 THEN 'READY' WHEN n >= 2700 THEN 'USABLE' ELSE 'NEED' END AS readiness, greatest(2700 - n, 0) * 2.0 AS eta_seconds, CASE WHEN n >= 2700 AND gap_pct < 5 THEN 'OK' WHEN n >= 1500 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status, {_listed(_ISSUES | _mid_checks())} AS issues, {_listed(_WARNINGS)} AS warnings FROM q""")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness, final status, issues and warnings from one row of metrics."""
    t = ticks(spark, sf_dir, SHORT)
    seen = previous_value(t, [], ["us", "seq"], F.col("us"), "before_us")
    gap = (F.col("us") - F.col("before_us")) / 1e6
    mids = [F.try_divide(F.count(F.when(F.col("asset") == a, F.col("mid"))), F.count_if(F.col("asset") == a)).alias(f"mids_{a}") for a in ASSETS]
    open_from = F.call_function("div", F.max("us"), F.lit(SHORT * _MICRO))
    m = seen.agg(
        F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("span"), F.coalesce(F.sum(F.when(gap > GAP_SECONDS, gap)), F.lit(0.0)).alias("gap_seconds"), (F.count("pvs") / F.count("*")).alias("price_share"),
        F.max("tte").alias("tte_max"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("asset", "period_id").alias("contracts"), open_from.alias("last"), *mids,
    )
    still_open = t.groupBy("period_id").agg(F.countDistinct("ticker").alias("open"))
    m = m.join(still_open, F.col("last") == F.col("period_id"), "left").withColumn("settled", F.col("tickers") - F.coalesce("open", F.lit(0)))
    m = m.withColumn("gap_pct", F.try_divide(F.col("gap_seconds"), F.col("span")) * 100)
    listed = lambda checks: F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in checks.items()])), ",")
    return m.select("n", F.round("gap_pct", 6).alias("gap_pct"), S.readiness(F.col("n")).alias("readiness"), (F.greatest(2700 - F.col("n"), F.lit(0)) * 2.0).alias("eta_seconds"), S.final_status(F.col("n"), F.col("gap_pct")).alias("status"), listed(_ISSUES | _mid_checks()).alias("issues"), listed(_WARNINGS).alias("warnings"))


@query(ticks_sql() + "SELECT period_id" + "".join(f", max(CASE WHEN asset = '{a}' THEN mid END) AS {a}_mid, max(CASE WHEN asset = '{a}' THEN pvs END) AS {a}_pvs" for a in ASSETS) + ", count(DISTINCT CASE WHEN mid IS NOT NULL THEN asset END) AS n_valid FROM ticks GROUP BY period_id")
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each period."""
    t = ticks(spark, sf_dir)
    wide = t.groupBy("period_id").pivot("asset", ASSETS).agg(F.max("mid").alias("mid"), F.max("pvs").alias("pvs"))
    return wide.join(t.filter("mid is not null").groupBy("period_id").agg(F.countDistinct("asset").alias("n_valid")), "period_id", "left").na.fill(0, ["n_valid"])


@query(ticks_sql() + "SELECT period_id, asset, max(mid) AS mid FROM ticks WHERE asset IN (" + ", ".join(f"'{a}'" for a in ASSETS) + ") GROUP BY ALL")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows as one row for each asset again."""
    wide = long_to_wide(spark, sf_dir)
    long = wide.select("period_id", F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"{a}_mid").alias("mid"), F.col(f"{a}_pvs").alias("pvs")) for a in ASSETS])).alias("x"))
    held = ticks(spark, sf_dir).select("period_id", "asset").distinct()
    return long.select("period_id", "x.asset", "x.mid").join(held, ["period_id", "asset"], "left_semi")


@query(settled_sql() + "SELECT t.seq, t.asset, t.ticker, CASE WHEN s.result = 'YES' THEN 1 ELSE 0 END AS target FROM ticks t JOIN settlements s USING (ticker)")
def label_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with their contract's outcome."""
    t = ticks(spark, sf_dir)
    return t.join(settlements(t).select("ticker", "result"), "ticker").select("seq", "asset", "ticker", S.result_label(F.col("result")).alias("target"))


@query(settled_sql() + "SELECT asset, count(*) AS n, count(*) FILTER (WHERE result = 'YES') AS n_yes, count(*) FILTER (WHERE result = 'NO') AS n_no, round(avg(CASE WHEN result = 'YES' THEN 1.0 ELSE 0.0 END), 6) AS yes_rate FROM settlements GROUP BY asset")
def settlement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    yes = S.result_label(F.col("result"))
    return settlements(ticks(spark, sf_dir)).groupBy("asset").agg(F.count("*").alias("n"), F.count_if(yes == 1).alias("n_yes"), F.count_if(yes == 0).alias("n_no"), F.round(F.avg(yes), 6).alias("yes_rate"))


@query(settled_sql() + """SELECT DISTINCT t.ticker FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM settlements s WHERE s.ticker = t.ticker AND s.period_id % 3 <> 0)""")
def unsettled_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers without a result (every third period counts as open)."""
    t = ticks(spark, sf_dir)
    return t.select("ticker").distinct().join(settlements(t).filter("period_id % 3 <> 0"), "ticker", "left_anti")


@query(settled_sql() + "SELECT t.seq, t.ticker FROM ticks t WHERE t.ticker IN (SELECT ticker FROM settlements WHERE period_id % 5 <> 0)")
def train_tickers_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    t = ticks(spark, sf_dir)
    return t.select("seq", "ticker").join(settlements(t).filter("period_id % 5 <> 0"), "ticker", "left_semi").select("seq", "ticker")


@query(settled_sql() + "SELECT split_part(ticker, '-', 2) AS time_key, count(*) AS n, count(*) FILTER (WHERE result = 'YES') AS n_yes, CASE WHEN min(result) = max(result) THEN min(result) ELSE 'MX' END AS direction FROM settlements GROUP BY 1")
def period_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that close together."""
    s = settlements(ticks(spark, sf_dir)).withColumn("time_key", S.ticker_part(F.col("ticker"), "time_key"))
    return s.groupBy("time_key").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "YES").alias("n_yes"), F.when(F.min("result") == F.max("result"), F.min("result")).otherwise("MX").alias("direction"))


EDGE_SECONDS = 3600


@query(ticks_sql() + f"""SELECT ticker, round(avg(CASE WHEN us >= (period_id + 1) * {LONG * _MICRO} - {EDGE_SECONDS * _MICRO} THEN real_price END), 6) AS closing, round(avg(CASE WHEN us < period_id * {LONG * _MICRO} + {EDGE_SECONDS * _MICRO} THEN real_price END), 6) AS opening,
 CASE WHEN avg(CASE WHEN us >= (period_id + 1) * {LONG * _MICRO} - {EDGE_SECONDS * _MICRO} THEN real_price END) >= avg(CASE WHEN us < period_id * {LONG * _MICRO} + {EDGE_SECONDS * _MICRO} THEN real_price END) THEN 'YES'
 WHEN avg(CASE WHEN us >= (period_id + 1) * {LONG * _MICRO} - {EDGE_SECONDS * _MICRO} THEN real_price END) < avg(CASE WHEN us < period_id * {LONG * _MICRO} + {EDGE_SECONDS * _MICRO} THEN real_price END) THEN 'NO' END AS result FROM ticks GROUP BY ticker, period_id""")
def averaged_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average of the closing stretch against that of the opening one; null if either is empty."""
    t = ticks(spark, sf_dir)
    start, end = F.col("period_id") * LONG * _MICRO, (F.col("period_id") + 1) * LONG * _MICRO
    out = t.groupBy("ticker", "period_id").agg(F.avg(F.when(F.col("us") >= end - EDGE_SECONDS * _MICRO, F.col("real_price"))).alias("c"), F.avg(F.when(F.col("us") < start + EDGE_SECONDS * _MICRO, F.col("real_price"))).alias("o"))
    return out.select("ticker", F.round("c", 6).alias("closing"), F.round("o", 6).alias("opening"), F.when(F.col("c") >= F.col("o"), "YES").when(F.col("c") < F.col("o"), "NO").alias("result"))


_HISTORY = """, history AS (SELECT *, CASE WHEN result = 'YES' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY settle_us, asset) AS r FROM settlements),
flips AS (SELECT *, CASE WHEN y <> lag(y) OVER (ORDER BY r) THEN 1 ELSE 0 END AS flip FROM history),
states AS (SELECT asset, ticker, settle_us, r, avg(y) OVER (ORDER BY r ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rate4, CASE WHEN r < 3 THEN 0.5::DOUBLE ELSE sum(flip) OVER (ORDER BY r ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / (least(r, 8) - 1)::DOUBLE END AS osc FROM flips)
"""


def settlement_states(s: DataFrame) -> DataFrame:
    """After each settlement, in order of time and asset, the rate of the last four and the flips in the last eight.

    Rows get global numbers by a running count, then blocks of numbers are
    worked apart, each with the eight settlements before it.
    """
    order = ["settle_us", "asset", "ticker"]
    rows = s.withColumn("y", (F.col("result") == "YES").cast("int")).withColumn("_one", F.lit(0))
    rows = running(rows, ["_one"], order, F.lit(1), "_n", bucket=F.call_function("div", F.col("settle_us"), F.lit(DAY_US))).withColumn("_n", F.col("_n").cast("long"))
    own, nxt = (F.call_function("div", F.col("_n") + k, F.lit(BLOCK)) for k in (0, 8))
    rows = rows.withColumn("_own", own).withColumn("_b", F.explode(F.array_distinct(F.array(own, nxt))))
    by = Window.partitionBy("_b").orderBy("_n")
    flips = rows.withColumn("flip", F.when(F.col("y") != F.lag("y").over(by), 1).otherwise(0))
    osc = F.when(F.col("_n") < 3, 0.5).otherwise(F.sum("flip").over(by.rowsBetween(-6, 0)) / (F.least("_n", F.lit(8)) - 1))
    out = flips.withColumn("rate4", F.avg("y").over(by.rowsBetween(-3, 0))).withColumn("osc", osc)
    return out.filter("_b = _own").drop("_one", "_own", "_b", "flip", "y").withColumnRenamed("_n", "n_settled")


def latest_states(s: DataFrame) -> DataFrame:
    """settle_us with the last of the states of that time: rate4, osc and n_settled."""
    last = F.max_by(F.struct("rate4", "osc", "n_settled"), F.struct("asset", "ticker")).alias("s")
    return settlement_states(s).groupBy("settle_us").agg(last).select("settle_us", "s.*")


@query(settled_sql() + _HISTORY + "SELECT ticker, round(rate4, 6) AS rate4, round(osc, 6) AS osc, CASE WHEN osc > 0.6 THEN 'OSCILLATE' WHEN osc < 0.35 THEN 'TREND' ELSE 'MIXED' END AS regime FROM states")
def oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, W7, P41."""
    states = settlement_states(settled(spark, sf_dir))
    return states.select("ticker", F.round("rate4", 6).alias("rate4"), F.round("osc", 6).alias("osc"), S.regime(F.col("osc")).alias("regime"))


@query(settled_sql() + _HISTORY + "SELECT t.seq, round(arg_max(s.rate4, s.r), 6) AS rate4, round(arg_max(s.osc, s.r), 6) AS osc FROM ticks t LEFT JOIN states s ON s.settle_us <= t.us GROUP BY t.seq")
def asof_settlement_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest settlement state known at each tick."""
    latest = latest_states(settled(spark, sf_dir))
    joined = asof.asof_join(ticks(spark, sf_dir).select("seq", "us"), latest, "settle_us", [], ["rate4", "osc"], LONG * _MICRO)
    return joined.select("seq", F.round("rate4", 6).alias("rate4"), F.round("osc", 6).alias("osc"))


DEFERRED_SECONDS = 7200


@query(settled_sql() + f""", rolls AS (SELECT * FROM (SELECT seq, asset, us, lag(ticker) OVER (PARTITION BY asset ORDER BY us, seq) AS ticker, ticker AS now FROM ticks) WHERE ticker <> now)
SELECT r.seq, r.ticker, arg_min(s.result, s.settle_us) AS result FROM rolls r LEFT JOIN (SELECT ticker, settle_us + (hash_us % 10800) * 1000000 AS settle_us, result FROM (SELECT *, period_id * 7919 AS hash_us FROM settlements)) s ON s.ticker = r.ticker AND s.settle_us BETWEEN r.us AND r.us + {DEFERRED_SECONDS * _MICRO} GROUP BY r.seq, r.ticker""")
def deferred_settlement_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-over's outcome, if it arrives in time; later ones have expired."""
    t = ticks(spark, sf_dir)
    rolls = previous_value(t, ["asset"], ["us", "seq"], F.col("ticker"), "old").filter("old <> ticker").select("seq", F.col("old").alias("ticker"), "us")
    late = settlements(t).select("ticker", (F.col("settle_us") + (F.col("period_id") * 7919 % 10800) * _MICRO).alias("arrival_us"), "result")
    return asof.interval_join(rolls, late, ["ticker"], ["seq"], "us", "arrival_us", DEFERRED_SECONDS * _MICRO, ["result"]).select("seq", "ticker", "result")


LEADER = "click"


def with_leader(t: DataFrame, width_us: int = 3600 * _MICRO) -> DataFrame:
    """Ticks with the three momenta, and beside the other assets' rows the leading asset's last known mid and its momentum less their own.

    The leader's rows reach all others by a window over time buckets of the given
    width (what a task sorts at once), not by a join of times.
    """
    t = asof.momentum(t, ["asset"], "mid", {f"mom_{h}": h * _MICRO for h in HORIZONS})
    leads = (F.col("asset") == LEADER) & F.col("mid").isNotNull()
    t = asof.over_time(t.withColumn("_leads", F.when(leads, F.struct("mid", "mom_900"))), [], 0, [], {"_leader": "_leads"}, width_us)
    other = F.col("asset") != LEADER
    return t.withColumns({"lead_mid": F.when(other, F.col("_leader.mid")), "lead": F.when(other, F.col("_leader.mom_900") - F.col("mom_900"))}).drop("_leads", "_leader")


@query(ticks_sql() + ", now AS (SELECT seq, asset, us, mid, " + _NOW.format(c="mid") + f""" AS cur FROM ticks), moved AS (SELECT seq, asset, us, mid, round(cur - m.v, 6) AS mom FROM now LEFT JOIN {nearest_sql('mid', 900)} m USING (asset, us)),
leads AS (SELECT *, last_value(CASE WHEN asset = '{LEADER}' AND mid IS NOT NULL THEN {{'mid': mid, 'mom': mom}} END IGNORE NULLS) OVER (ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leader FROM moved)
SELECT seq, CASE WHEN asset <> '{LEADER}' THEN leader.mid END AS lead_mid, CASE WHEN asset <> '{LEADER}' THEN round(leader.mom - mom, 6) END AS lead FROM leads""")
def leader_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading asset's mid beside the others' rows, and its momentum less theirs."""
    t = with_leader(ticks(spark, sf_dir).select("seq", "asset", "us", "mid"))
    return t.select("seq", "lead_mid", F.round("lead", 6).alias("lead"))


SPARKS = 50


@query(ticks_sql() + f""", n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY us, seq) - 1 AS r, count(*) OVER (PARTITION BY asset) AS total, min(mid) OVER (PARTITION BY asset) AS low, max(mid) OVER (PARTITION BY asset) AS high FROM ticks WHERE mid IS NOT NULL),
k AS (SELECT *, CASE WHEN total <= {SPARKS} THEN r ELSE CAST(ceil(r * {SPARKS}::DOUBLE / total) AS BIGINT) END AS pos FROM n) SELECT asset, pos AS at, coalesce(least(7, CAST(floor((mid - low) / nullif(high - low, 0) * 7.999) AS INTEGER)), 0) AS level FROM k WHERE pos < {SPARKS} AND r = CASE WHEN total <= {SPARKS} THEN r ELSE CAST(floor(pos * total / {SPARKS}::DOUBLE) AS BIGINT) END""")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of 50 of an asset's mids, on eight levels of their range."""
    t = ticks(spark, sf_dir).filter("mid is not null").select("asset", "us", "seq", "mid")
    numbered = running(t, ["asset"], ["us", "seq"], F.lit(1), "r").withColumn("r", F.col("r").cast("long") - 1)
    span = t.groupBy("asset").agg(F.min("mid").alias("low"), F.max("mid").alias("high"), F.count("*").alias("total"))
    few = F.col("total") <= SPARKS
    sampled = numbered.join(span, "asset").withColumn("at", F.when(few, F.col("r")).otherwise(F.ceil(F.col("r") * float(SPARKS) / F.col("total"))))
    sampled = sampled.filter(F.col("at") < SPARKS).filter(few | (F.col("r") == F.floor(F.col("at") * F.col("total") / float(SPARKS))))
    level = F.floor(F.try_divide(F.col("mid") - F.col("low"), F.col("high") - F.col("low")) * 7.999).cast("int")
    return sampled.select("asset", "at", F.coalesce(F.least(F.lit(7), level), F.lit(0)).alias("level"))


@query(ticks_sql() + ", now AS (SELECT seq, asset, us, " + _NOW.format(c="mid") + " AS cur FROM ticks) SELECT t.seq, t.asset, t.mid, t.spread, t.pvs, t.ob_imbalance, t.tte AS time_to_expiry, round(n.cur - m.v, 6) AS mom_900 FROM ticks t JOIN now n USING (seq) LEFT JOIN " + nearest_sql("mid", 900) + " m ON m.asset = t.asset AND m.us = t.us")
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON replies built from events, read, joined by cycle and turned into feature rows; every third reply lacks its strike."""
    from ..sources.features import feature_rows

    t = ticks(spark, sf_dir).withColumn("cycle", F.col("seq"))
    closes = F.date_format(F.timestamp_micros((F.col("period_id") + 1) * LONG * _MICRO), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    market = F.struct("ticker", F.lit("active").alias("status"), "yes_bid", "yes_ask", F.when(F.col("k") % 3 != 0, F.col("floor_strike")).alias("floor_strike"), closes.alias("close_time"))
    markets = t.select("cycle", "asset", "seq", "us", F.to_json(F.struct(F.array(market).alias("markets"))).alias("payload"))
    k = F.col("k").cast("double")
    book = F.struct(F.array(F.array(F.lit(1.0), k)).alias("yes"), F.array(F.array(F.lit(1.0), 99 - k)).alias("no"))
    books = t.select("cycle", "asset", F.to_json(F.struct(book.alias("orderbook"))).alias("payload"))
    rows = feature_rows(markets, books, t.select("cycle", "asset", F.col("real_price").alias("price")), [900 * _MICRO])
    return rows.select("seq", "asset", "mid", "spread", "pvs", "ob_imbalance", "time_to_expiry", "mom_900")


POLL_US = 900 * _MICRO
_POLLED = ticks_sql() + f""", polled AS (SELECT *, us // {POLL_US} AS cycle, k % 7 <> 0 AS ok, round(1 / (1 / real_price), 4) AS price FROM ticks QUALIFY row_number() OVER (PARTITION BY asset, us // {POLL_US} ORDER BY us DESC, seq DESC) = 1),
replies AS (SELECT cycle, asset, seq, us, price, CASE WHEN ok THEN ticker END AS ticker, CASE WHEN ok THEN yes_bid END AS yes_bid, CASE WHEN ok THEN yes_ask END AS yes_ask, CASE WHEN ok THEN mid END AS mid, CASE WHEN ok THEN spread END AS spread, CASE WHEN ok THEN user_id ELSE 0 END AS volume, CASE WHEN ok THEN k ELSE 0 END AS oi,
CASE WHEN ok AND k % 3 <> 0 THEN floor_strike END AS strike, CASE WHEN ok THEN tte END AS time_to_expiry, ob_imbalance, CASE WHEN NOT ok THEN 'no_market' END AS error FROM polled WHERE cycle IN (SELECT cycle FROM polled WHERE ok)),
opened AS (SELECT *, coalesce(strike, first_value(price) OVER (PARTITION BY asset, ticker ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS floor_strike, {_NOW.format(c='mid')} AS cur FROM replies),
rows AS (SELECT s.*, price AS real_price, CASE WHEN floor_strike > 0 THEN round((price - floor_strike) / floor_strike * 100, 4) END AS price_vs_strike_pct, """ + ", ".join(f"round(cur - m{h}.v, 6) AS mom_{h}" for h in HORIZONS) + " FROM opened s" + "".join(f" LEFT JOIN {nearest_sql('mid', h).replace('FROM ticks', 'FROM replies')} m{h} USING (asset, us)" for h in HORIZONS) + ")\n"
_WIDE = [(c, {"mom_5s": "mom_900", "mom_15s": "mom_1800", "mom_30s": "mom_3600"}.get(c, c)) for c in ASSET_COLUMNS]


@query(_POLLED + "SELECT cycle, max(us) AS us, " + ", ".join(f"max(CASE WHEN asset = '{a}' THEN {c} END) AS {a}_{name}" for a in ASSETS for name, c in _WIDE) + ", CAST(count(*) FILTER (WHERE mid IS NOT NULL AND error IS NULL) AS INTEGER) AS n_valid FROM rows GROUP BY cycle")
def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll of all assets a cycle: JSON markets (some empty), books and one reply of rates, to the wide row with three momenta."""
    from ..sources.features import feature_rows, wide_rows
    from ..sources.snapshots import rate_rows

    t = ticks(spark, sf_dir).withColumn("cycle", F.call_function("div", F.col("us"), F.lit(POLL_US)))
    rank = F.row_number().over(Window.partitionBy("asset", "cycle").orderBy(F.desc("us"), F.desc("seq")))
    t = staged(t.withColumn("_r", rank).filter("_r = 1").drop("_r"), "polls")
    closes = F.date_format(F.timestamp_micros((F.col("period_id") + 1) * LONG * _MICRO), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    market = F.struct("ticker", F.lit("active").alias("status"), "yes_bid", "yes_ask", F.col("user_id").alias("volume"), F.col("k").alias("open_interest"), F.when(F.col("k") % 3 != 0, F.col("floor_strike")).alias("floor_strike"), closes.alias("close_time"))
    listed = F.filter(F.array(market), lambda _: F.col("k") % 7 != 0)
    markets = t.select("cycle", "asset", "seq", "us", F.to_json(F.struct(listed.alias("markets"))).alias("payload"))
    k = F.col("k").cast("double")
    book = F.struct(F.array(F.array(F.lit(1.0), k)).alias("yes"), F.array(F.array(F.lit(1.0), 99 - k)).alias("no"))
    books = t.select("cycle", "asset", F.to_json(F.struct(book.alias("orderbook"))).alias("payload"))
    rates = t.groupBy("cycle").agg(F.map_from_entries(F.collect_list(F.struct("asset", (1 / F.col("real_price")).cast("string").alias("rate")))).alias("rates"))  # an entry for each asset
    prices = rate_rows(rates.select("cycle", F.to_json(F.struct("rates")).alias("payload")), ASSETS)
    return wide_rows(feature_rows(markets, books, prices, [h * _MICRO for h in HORIZONS]), ASSETS, [f"mom_{h}" for h in HORIZONS])


@query(ticks_sql() + """SELECT seq, side, CAST(least(99, greatest(1, coalesce(CASE side WHEN 'YES' THEN yes_ask ELSE yes_bid END, floor(mid * 100)))) AS INTEGER) AS limit_cents FROM ticks, (VALUES ('YES'), ('NO')) s(side) WHERE mid IS NOT NULL""")
def limit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order on either side of each quote would ask: the other side's price, or the mid where nobody offers."""
    t = ticks(spark, sf_dir).filter("mid is not null").withColumn("side", F.explode(F.array(F.lit("YES"), F.lit("NO"))))
    return t.select("seq", "side", S.limit_price_cents(F.col("side"), F.col("yes_ask"), 100 - F.col("yes_bid"), F.col("mid")).alias("limit_cents"))
