"""Order-dependent operators whose parallelism isn't bounded by the number of keys.

A key (an asset) may hold a third of all rows. Each operator therefore cuts a
key's rows into buckets of time and works in (key, bucket): values that cross a
bucket's border are carried by a small table with a row for each bucket, or by
copying the rows of one lookback into the next bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def time_bucket(us: str = "us", width: int = DAY_US) -> Column:
    return F.call_function("div", F.col(us), F.lit(width))


def bucket_width(df: DataFrame, keys: list[str], rows: int, lookback_us: int = 0, us: str = "us") -> int:
    """A bucket's width with which the busiest key has about so many rows a bucket, but no less than the lookback."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(us).alias("a"), F.max(us).alias("b"))
    width = most.agg(F.min((F.col("b") - F.col("a") + 1) * rows / F.col("n"))).first()[0]
    return max(int(width or DAY_US), lookback_us, 1)


def bucket_parts(df: DataFrame, keys: list[str], lookback_us: int, rows: int = 100_000, us: str = "us") -> tuple[int, int]:
    """For rows that look back: a bucket's width, of one to four lookbacks (a day at least), and the number of partitions to deal buckets to.

    The busiest key has about so many rows a bucket; a partition has half of that,
    copies included, so that it seldom gets more than one or two buckets.
    """
    widest = max(DAY_US, 4 * lookback_us)
    most = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(us).alias("a"), F.max(us).alias("b"))
    width, n = most.agg(F.min((F.col("b") - F.col("a") + 1) * rows / F.col("n")), F.sum("n")).first()
    width = max(lookback_us, min(widest, int(width or widest)), 1)
    return width, row_parts((n or 0) * (1 + lookback_us / width), rows)


def row_parts(n: float, rows: int = 100_000) -> int:
    """The number of partitions to deal so many rows to: half of rows each, so that one seldom gets more than one or two groups of that size."""
    return int(n * 2 / rows) + 1


def carried_values(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, _b, names): for each bucket of rows the last non-null values of the buckets before; one row for each bucket."""
    ends = rows.groupBy(*keys, "_b").agg(*[F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(n) for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "_b", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in values])


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """df with the last non-null value strictly before each row, over all of the key's rows; df is read twice."""
    rows = df.withColumn("_b", time_bucket() if bucket is None else bucket).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried_values(rows, keys, order, {"_carry": F.col("_v")})
    seen = rows.withColumn("_prev", F.last("_v", ignorenulls=True).over(local))
    return seen.join(carried, [*keys, "_b"]).withColumn(name, F.coalesce("_prev", "_carry")).drop("_b", "_v", "_prev", "_carry")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, total: str, peak: str | None = None, bucket: Column | None = None) -> DataFrame:
    """df with the running sum of value and, if named, that sum's running maximum (at least 0); df is read twice.

    order must be total: rows that tie in it may be summed in either order.
    """
    rows = df.withColumn("_b", time_bucket() if bucket is None else bucket).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_v").over(local))
    rows = rows.withColumn("_top", F.max("_sum").over(local))
    ends = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_all"), F.max("_top").alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    ends = ends.withColumn("_peak", F.coalesce(F.max(F.col("_offset") + F.col("_most")).over(before), F.lit(0.0))).drop("_all", "_most")
    out = rows.join(ends, [*keys, "_b"]).withColumn(total, F.col("_offset") + F.col("_sum"))
    if peak:
        out = out.withColumn(peak, F.greatest(F.lit(0.0), F.col("_peak"), F.col("_offset") + F.col("_top")))
    return out.drop("_b", "_v", "_sum", "_top", "_offset", "_peak")


def with_lookback(df: DataFrame, lookback_us: int, us: str = "us", width: int | None = None) -> DataFrame:
    """df with _b and _copy: each row in its own bucket and, where the lookback reaches there, copied into the next ones."""
    width = width or max(DAY_US, 4 * lookback_us)
    own = time_bucket(us, width)
    last = F.call_function("div", F.col(us) + lookback_us, F.lit(width))
    return df.withColumn("_own", own).withColumn("_b", F.explode(F.sequence(own, last))).withColumn("_copy", F.col("_b") != F.col("_own")).drop("_own")


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column, bucket: Column | None = None) -> DataFrame:
    """(keys, flag, run): the lengths of all runs of equal non-null flags."""
    rows = df.withColumn("flag", flag).filter(F.col("flag").isNotNull())
    rows = previous_value(rows, keys, order, F.col("flag"), "_before", bucket)
    rows = running(rows, keys, order, F.when(F.col("flag") == F.col("_before"), 0).otherwise(1), "_island", bucket=bucket)
    return rows.groupBy(*keys, "_island").agg(F.first("flag").alias("flag"), F.count("*").alias("run")).drop("_island")
