"""Landed JSON replies as typed rows, in batch and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

MARKETS = T.StructType().add("markets", T.ArrayType(T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("status", T.StringType()), T.StructField("yes_bid", T.IntegerType()), T.StructField("yes_ask", T.IntegerType()),
    T.StructField("volume", T.LongType()), T.StructField("open_interest", T.LongType()), T.StructField("floor_strike", T.DoubleType()), T.StructField("close_time", T.StringType()),
])))
_LEVELS = T.ArrayType(T.ArrayType(T.DoubleType()))
BOOKS = T.StructType().add("orderbook", T.StructType().add("yes", _LEVELS).add("no", _LEVELS))
RATES = T.StructType().add("rates", T.MapType(T.StringType(), T.StringType()))


def read_landed(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """JSON files of a landing folder; a broken line has null fields and its text in _corrupt_record."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema.add("_corrupt_record", "string") if "_corrupt_record" not in schema.names else schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def market_rows(replies: DataFrame) -> DataFrame:
    """replies (payload) with the first market's fields, defaults and an error."""
    first = F.get(F.from_json("payload", MARKETS)["markets"], F.lit(0))
    out = replies.withColumn("_m", first)
    fields = ["ticker", "status", "yes_bid", "yes_ask", "floor_strike", "close_time"]
    return out.select(
        *replies.columns, *[F.col(f"_m.{c}").alias(c) for c in fields], F.coalesce("_m.volume", F.lit(0).cast("long")).alias("volume"), F.coalesce("_m.open_interest", F.lit(0).cast("long")).alias("oi"),
        F.substring(F.when(F.col("_m").isNull(), "no_market"), 1, 60).alias("error"),
    )


def book_rows(replies: DataFrame) -> DataFrame:
    """replies (payload) with depths, imbalance and asks."""
    out = replies.withColumn("_o", F.from_json("payload", BOOKS)["orderbook"])
    yes, no = F.col("_o.yes"), F.col("_o.no")
    yes_ask, no_ask = S.best_asks(yes, no)
    out = out.withColumns({"yes_depth": S.depth(yes), "no_depth": S.depth(no), "yes_ask": yes_ask, "no_ask": no_ask})
    return out.withColumn("ob_imbalance", S.book_imbalance(F.col("yes_depth"), F.col("no_depth"))).drop("_o")


def rate_rows(replies: DataFrame, symbols: list[str]) -> DataFrame:
    """A row for each wanted symbol of a reply, with the price that its rate inverts to."""
    rates = F.from_json("payload", RATES)["rates"]
    rows = replies.select(*[c for c in replies.columns if c != "payload"], F.explode(rates).alias("asset", "rate"))
    return rows.filter(F.col("asset").isin(symbols)).select(*[c for c in replies.columns if c != "payload"], "asset", S.invert_rate(F.col("rate")).alias("price"))


def assemble_snapshot(markets: DataFrame, books: DataFrame, prices: DataFrame, cycle: str = "cycle") -> DataFrame:
    """One row for each cycle and asset; cycles in which every market failed are left out."""
    joined = markets.join(books, [cycle, "asset"], "left").join(prices, [cycle, "asset"], "left")
    good = markets.filter(F.col("error").isNull()).select(cycle).distinct()
    return joined.join(good, cycle, "left_semi")
