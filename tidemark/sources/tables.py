"""Feature tables and fact tables: schemas, readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSETS = ("btc", "eth", "sol", "xrp")
#: The columns of an asset in the wide table.
ASSET_COLUMNS = {
    "ticker": "string", "mid": "double", "spread": "double", "yes_bid": "integer", "yes_ask": "integer", "volume": "long", "oi": "long", "floor_strike": "double", "time_to_expiry": "double",
    "ob_imbalance": "double", "real_price": "double", "price_vs_strike_pct": "double", "mom_5s": "double", "mom_15s": "double", "mom_30s": "double", "error": "string",
}
#: The columns of the fact tables.
TRADES = "id long, ts_unix double, ts_iso string, asset string, side string, contracts int, entry_price double, fee double, ticker string, edge double, z_score double, model_p double, confidence double, order_id string, order_status string, settled string, pnl double, bankroll_after double, consensus string, avg_z double, agreement double, tte_at_entry double, edge_mode string, bankroll_before double"
SETTLEMENTS = "id long, ts_unix double, ts_iso string, asset string, ticker string, result string"
TRANSITIONS = "ts string, asset string, old_ticker string, new_ticker string, new_floor_strike double"


def wide_schema(assets: tuple[str, ...] = ASSETS) -> T.StructType:
    """The wide feature row of any list of assets."""
    schema = T.StructType().add("ts", "string").add("ts_unix", "double")
    for asset in assets:
        for name, kind in ASSET_COLUMNS.items():
            schema.add(f"{asset}_{name}", kind)
    return schema.add("n_valid", "integer")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null, so that comparisons mean what they say."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema])


def read_features_csv(spark: SparkSession, path: str, assets: tuple[str, ...] = ASSETS) -> DataFrame:
    return no_nan(spark.read.schema(wide_schema(assets)).option("header", True).csv(path))


def read_features_table(spark: SparkSession, path: str) -> DataFrame:
    return no_nan(spark.read.parquet(path))


def resolve_source(spark: SparkSession, *paths: str, assets: tuple[str, ...] = ASSETS) -> DataFrame:
    """The first path that exists (on any file system of Spark), read by its ending."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(hadoop).exists(p):
            return read_features_csv(spark, path, assets) if path.endswith(".csv") else read_features_table(spark, path)
    raise FileNotFoundError(", ".join(paths))


def wide_rows_to_long(wide: DataFrame, assets: tuple[str, ...] = ASSETS) -> DataFrame:
    """(ts, ts_unix, asset and its columns), one row for each asset."""
    rows = [F.struct(F.lit(a).alias("asset"), *[F.col(f"{a}_{c}").cast(k).alias(c) for c, k in ASSET_COLUMNS.items()]) for a in assets]
    return wide.select("ts", "ts_unix", F.explode(F.array(*rows)).alias("x")).select("ts", "ts_unix", "x.*")


def long_rows_to_wide(long: DataFrame, assets: tuple[str, ...] = ASSETS) -> DataFrame:
    named = long.groupBy("ts", "ts_unix").pivot("asset", list(assets)).agg(*[F.first(c).alias(c) for c in ASSET_COLUMNS])
    valid = long.groupBy("ts", "ts_unix").agg(F.count_if(F.col("mid").isNotNull() & F.col("error").isNull()).cast("int").alias("n_valid"))
    return named.join(valid, ["ts", "ts_unix"]).select(*wide_schema(assets).names)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def append_features(long: DataFrame, path: str) -> None:
    append(long.withColumn("date", F.to_date(F.timestamp_seconds("ts_unix"))), path, "date", "asset")


def append_trades(trades: DataFrame, path: str) -> None:
    """Entries as facts; what settlement fills in starts as null."""
    missing = {"settled": "string", "pnl": "double", "bankroll_after": "double"}
    append(trades.withColumns({c: F.lit(None).cast(k) for c, k in missing.items() if c not in trades.columns}), path)


def settle_trades_view(trades: DataFrame, settled: DataFrame, payoff: Column) -> DataFrame:
    """Trades with results filled in where they are open: a view, so nothing is updated. payoff may use result."""
    last = settled.groupBy("ticker").agg(F.max_by("result", "id").alias("result"))
    joined = trades.join(last, "ticker", "left")
    return joined.withColumn("pnl", F.coalesce("pnl", payoff)).withColumn("settled", F.coalesce("settled", "result")).drop("result")


def record_ticks(state: DataFrame, keys: list[str], asset: str, value: str, name: str) -> DataFrame:
    """One row for each key, with a JSON map from asset to value."""
    return state.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(asset, value))))).alias(name))


def read_map(df: DataFrame, name: str, kind: str = "map<string,string>") -> DataFrame:
    return df.withColumn(name, F.from_json(name, kind))


def export_csv(df: DataFrame, path: str, order: str) -> int:
    """Ordered CSV parts with a header; returns the number of rows, counted as they are written."""
    seen = Observation()
    df.orderBy(order).observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def write_predictions(scores: DataFrame, path: str) -> None:
    """(model_p, actual) as CSV parts with a header."""
    scores.select(F.col("prob").alias("model_p"), F.col("y").alias("actual")).write.mode("overwrite").option("header", True).csv(path)


def append_transitions(transitions: DataFrame, path: str) -> None:
    append(transitions, path, "asset")
