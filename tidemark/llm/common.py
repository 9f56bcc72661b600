"""What the corpus operators share: tables in the shared folder, global row numbers, small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import scratch, shared_dir
from ..sources.staging import staged as written

__all__ = ["SPACES", "let", "row_numbers", "scratch", "shared_dir", "words", "written"]

#: Words are runs of characters outside these six ASCII spaces.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """All words in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "row_number") -> DataFrame:
    """df with a gapless number from 0 in the given order, without a window over all rows.

    Rows are range-partitioned by the order, numbered within partitions, and
    moved up by the partitions before. Equal rows may take each other's numbers.
    The sorted rows are written once, so both passes see the same partitions.
    df's columns travel in one struct, so their names don't matter but for ``name``.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tagged = df.select(F.struct("*").alias("row"), *[c.alias(f"key{k}") for k, c in enumerate(keys)], F.monotonically_increasing_id().alias("tie"))
    by = [*(f"key{k}" for k in range(len(keys))), "tie"]
    ordered = tagged.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "row",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    )
    ordered = written(ordered, "ordered")
    # a row for each partition: its number is bounded by the shuffle's partitions
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ordered.join(F.broadcast(starts), "part").select("row.*", (F.col("start") + F.col("at")).alias(name))
