"""From landed replies to feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.asof import momentum
from . import snapshots
from .tables import ASSET_COLUMNS


def strike_or_opening(df: DataFrame, strike: str = "floor_strike", price: str = "real_price") -> Column:
    """The strike, or the first known price of the asset's contract where the reply has none."""
    by = Window.partitionBy("asset", "ticker").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.col(strike), F.first(price, ignorenulls=True).over(by))


def feature_rows(markets: DataFrame, books: DataFrame, prices: DataFrame, horizons_us: Sequence[int]) -> DataFrame:
    """One row for each cycle and asset with quotes, book, price, distance to the strike and momentum.

    markets: cycle, asset, seq, us, payload; books: cycle, asset, payload; prices: cycle, asset, price.
    """
    book = snapshots.book_rows(books).select("cycle", "asset", "ob_imbalance", "yes_depth", "no_depth")
    rows = snapshots.assemble_snapshot(snapshots.market_rows(markets).drop("payload"), book, prices.withColumnRenamed("price", "real_price"))
    bid, ask = F.col("yes_bid"), F.col("yes_ask")
    rows = rows.withColumns({"mid": S.mid_price(bid, ask), "spread": S.spread(bid, ask), "floor_strike": strike_or_opening(rows)})
    closes = F.unix_micros(S.parse_close_time(F.col("close_time")))
    rows = rows.withColumns({"time_to_expiry": S.seconds_to_close(closes, F.col("us")), "pvs": S.price_vs_strike(F.col("real_price"), F.col("floor_strike"))})
    return momentum(rows, ["asset"], "mid", {f"mom_{h // 1_000_000}": h for h in horizons_us})


#: The columns of feature_rows that a wide row names otherwise.
RENAMED = {"price_vs_strike_pct": "pvs"}


def wide_rows(rows: DataFrame, assets: Sequence[str], momenta: Sequence[str]) -> DataFrame:
    """A row for each cycle: every asset's columns side by side, in the order of the wide schema, and the number of valid assets.

    momenta: the columns of rows that stand for the schema's momenta, shortest horizon first.
    """
    of = {**{c: RENAMED.get(c, c) for c in ASSET_COLUMNS}, **dict(zip([c for c in ASSET_COLUMNS if c.startswith("mom_")], momenta, strict=True))}
    cells = [F.first(F.when(F.col("asset") == a, F.col(c)), ignorenulls=True).cast(ASSET_COLUMNS[name]).alias(f"{a}_{name}") for a in assets for name, c in of.items()]
    valid = F.count_if(F.col("mid").isNotNull() & F.col("error").isNull() & F.col("asset").isin(*assets)).cast("int")
    return rows.groupBy("cycle").agg(F.max("us").alias("us"), *cells, valid.alias("n_valid"))
