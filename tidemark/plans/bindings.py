"""The given tables as market data, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordered import row_parts
from ..sources.staging import staged

#: Seconds of a period: the short one for structure, the long one for whatever is labelled.
SHORT, LONG = 900, 21_600

#: The traded assets that the event types stand for; the last one has none.
STANDS_FOR = {"click": "btc", "error": "eth", "purchase": "sol", "signup": "xrp"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, period: int = LONG) -> DataFrame:
    """events as long ticks: one row for each moment and asset; large tables are dealt to as many partitions as their rows ask for."""
    events = table(spark, sf_dir, "events")
    parts = row_parts(events.count())
    return ticks_of(events, period, parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None)


def ticks_of(events: DataFrame, period: int = LONG, parts: int | None = None) -> DataFrame:
    """Rows of events as ticks; a period's rows have to be there together, since its first price is its strike. parts: the partitions that periods are dealt to, else Spark's choice."""
    micros = period * 1_000_000
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("asset"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(k > 0, k).alias("yes_bid"), F.when((k > 0) & (F.col("event_id") % 10 != 0), F.least(F.lit(99), k + 1 + (F.col("user_id") % 5).cast("int"))).alias("yes_ask"), k.alias("k"),
        S.nan_to_null(F.lit(100.0) + F.col("value")).alias("real_price"),
    )
    base = base.withColumn("period_id", F.call_function("div", F.col("us"), F.lit(micros)))
    base = base.withColumn("ticker", F.concat(F.lit("KX"), F.upper("asset"), F.lit("15M-"), F.col("period_id").cast("string"), F.lit("-00")))
    if parts:
        base = base.repartition(parts, "asset", "period_id")
    opening = Window.partitionBy("asset", "period_id").orderBy("us", "seq")
    out = base.withColumn("floor_strike", F.first("real_price").over(opening)).withColumn("tte", ((F.col("period_id") + 1) * micros - F.col("us")) / 1e6)
    bid, ask = F.col("yes_bid"), F.col("yes_ask")
    return out.withColumns({
        "mid": S.mid_price(bid, ask), "spread": S.spread(bid, ask), "pvs": S.price_vs_strike(F.col("real_price"), F.col("floor_strike")),
        "ob_imbalance": S.book_imbalance(F.col("k").cast("double"), 99.0 - F.col("k")),
    })


def settlements(t: DataFrame, period: int = LONG) -> DataFrame:
    """asset, ticker, period_id, settle_us, result: YES if a period's last price is at least its first."""
    order = F.struct("us", "seq")
    last = t.groupBy("asset", "ticker", "period_id").agg(F.max_by("real_price", order).alias("last"), F.min_by("real_price", order).alias("strike"))
    return last.select("asset", "ticker", "period_id", ((F.col("period_id") + 1) * period * 1_000_000).alias("settle_us"), F.when(F.col("last") >= F.col("strike"), "YES").otherwise("NO").alias("result"))


def settled(spark: SparkSession, sf_dir: str, period: int = LONG) -> DataFrame:
    """The settlements as a staged table: a row for each contract, from one pass over the ticks."""
    return staged(settlements(ticks(spark, sf_dir, period), period), "settlements")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as trades: an order's status is the outcome, P is pending."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    out = lines.join(orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("asset"),
        F.when(F.col("l_linestatus") == "O", "YES").otherwise("NO").alias("side"), F.col("l_quantity").alias("contracts"), (F.col("l_discount") * 10).alias("price"),
        F.when(status == "F", F.lit(False)).when(status == "O", F.lit(True)).alias("won_yes"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), F.date_format("l_shipdate", "yyyy-MM").alias("period"),
    )
    out = out.withColumn("fee", S.taker_fee(F.col("contracts"), F.col("price")))
    return out.withColumn("pnl", S.binary_payoff(F.col("side"), F.col("won_yes"), F.col("contracts"), F.col("price"), F.col("fee")))


def ticks_sql(period: int = LONG) -> str:
    micros = period * 1_000_000
    return f"""WITH base AS (SELECT event_id AS seq, event_type AS asset, user_id, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 100.0::DOUBLE + value AS real_price FROM events),
quoted AS (SELECT *, CASE WHEN k > 0 THEN k END AS yes_bid, CASE WHEN k > 0 AND seq % 10 <> 0 THEN CAST(least(99, k + 1 + user_id % 5) AS INTEGER) END AS yes_ask, us // {micros} AS period_id FROM base),
struck AS (SELECT *, 'KX' || upper(asset) || '15M-' || period_id || '-00' AS ticker, first_value(real_price) OVER (PARTITION BY asset, period_id ORDER BY us, seq) AS floor_strike, ((period_id + 1) * {micros} - us) / 1e6::DOUBLE AS tte FROM quoted),
ticks AS (SELECT *, CASE WHEN yes_bid > 0 AND yes_ask > 0 THEN (yes_bid + yes_ask) / 200.0::DOUBLE WHEN yes_bid > 0 THEN yes_bid / 100.0::DOUBLE WHEN yes_ask > 0 THEN yes_ask / 100.0::DOUBLE END AS mid,
 CASE WHEN yes_bid > 0 AND yes_ask > 0 THEN (yes_ask - yes_bid) / 100.0::DOUBLE END AS spread, CASE WHEN floor_strike > 0 THEN round((real_price - floor_strike) / floor_strike * 100, 4) END AS pvs,
 round((k::DOUBLE - (99.0::DOUBLE - k)) / nullif(k::DOUBLE + (99.0::DOUBLE - k), 0), 4) AS ob_imbalance FROM struck)
"""


def settled_sql(period: int = LONG) -> str:
    return ticks_sql(period) + f""", settlements AS (SELECT asset, ticker, period_id, (period_id + 1) * {period * 1_000_000} AS settle_us,
 CASE WHEN arg_max(real_price, (us, seq)) >= any_value(floor_strike) THEN 'YES' ELSE 'NO' END AS result FROM ticks GROUP BY asset, ticker, period_id)
"""


def fee_sql(contracts: str, price: str, rate: float) -> str:
    return f"(CASE WHEN {contracts} > 0 AND {price} > 0 AND {price} < 1 THEN ceil({rate}::DOUBLE * {contracts} * {price} * (1 - {price}) * 100) / 100.0::DOUBLE ELSE 0.0::DOUBLE END)"


def ledger_sql() -> str:
    return f"""WITH joined AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_returnflag AS asset, CASE WHEN l_linestatus = 'O' THEN 'YES' ELSE 'NO' END AS side, l_quantity AS contracts, l_discount * 10 AS price,
 CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS won_yes, epoch_us(l_shipdate) AS us, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
charged AS (SELECT *, {fee_sql('contracts', 'price', 0.07)} AS fee FROM joined),
ledger AS (SELECT *, CASE WHEN won_yes IS NOT NULL THEN round((CASE WHEN side = 'YES' THEN 1 ELSE -1 END) * (CASE WHEN won_yes THEN contracts * (1 - price) ELSE -contracts * price END) - fee, 4) + 0.0 END AS pnl FROM charged)
"""
