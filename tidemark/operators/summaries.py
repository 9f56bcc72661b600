"""Mergeable summaries of ordered rows.

A key's rows are cut into buckets that follow the order. One pass makes a
summary of each bucket: runs of equal flags (the first, the last and the longest
of each flag) and the running sum (its total, highest and lowest value, and
worst drop from a high to a later low). Two neighbours' summaries merge into
theirs together, and merging is associative: what a key holds follows from a
row for each bucket, and so does the state before any bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

RUNS = ("first_flag", "first_run", "last_flag", "last_run", "longest_true", "longest_false", "n")
SUMS = ("total", "top", "low", "drop")


def bucket_summaries(df: DataFrame, keys: list[str], order: list[str], bucket: Column, flag: Column, value: Column) -> DataFrame:
    """(keys, _b, s): the summary of each bucket's rows with a non-null flag; a null value adds nothing.

    order must be total and rise with the bucket. The sums' highs and lows are
    at least and at most 0, the sum before the first row. All steps need the
    rows of a key and bucket together: one shuffle.
    """
    by, upto = Window.partitionBy(*keys, "_b").orderBy(*order), Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, *order, bucket.alias("_b"), flag.alias("_flag"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("_v")).filter("_flag is not null")
    rows = rows.withColumns({"_new": F.when(F.col("_flag") == F.lag("_flag").over(by), 0).otherwise(1), "_sum": F.sum("_v").over(upto)})
    rows = rows.withColumns({"_island": F.sum("_new").over(upto), "_top": F.greatest(F.lit(0.0), F.max("_sum").over(upto))})
    runs = rows.groupBy(*keys, "_b", "_island").agg(F.first("_flag").alias("_flag"), F.count("*").alias("_run"), F.sum("_v").alias("_v"), F.max("_top").alias("_top"), F.min("_sum").alias("_low"), F.max(F.col("_top") - F.col("_sum")).alias("_drop"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("_run"))), F.lit(0).cast("long"))
    made = {
        "first_flag": F.min_by("_flag", "_island"), "first_run": F.min_by("_run", "_island"), "last_flag": F.max_by("_flag", "_island"), "last_run": F.max_by("_run", "_island"), "longest_true": longest(F.col("_flag")), "longest_false": longest(~F.col("_flag")), "n": F.sum("_run"),
        "total": F.sum("_v"), "top": F.max("_top"), "low": F.least(F.lit(0.0), F.min("_low")), "drop": F.max("_drop"),
    }
    return runs.groupBy(*keys, "_b").agg(*[c.alias(n) for n, c in made.items()]).select(*keys, "_b", F.struct(*RUNS, *SUMS).alias("s"))


def merge(a: Column, b: Column) -> Column:
    """The summary of a's rows and then b's; a null one is that of no rows."""
    joined = F.when(a["last_flag"] == b["first_flag"], a["last_run"] + b["first_run"]).otherwise(F.lit(0).cast("long"))
    longest = lambda name, c: F.greatest(a[name], b[name], F.when(c, joined).otherwise(F.lit(0).cast("long")))
    merged = F.struct(
        a["first_flag"].alias("first_flag"), F.when((a["first_run"] == a["n"]) & (a["last_flag"] == b["first_flag"]), a["n"] + b["first_run"]).otherwise(a["first_run"]).alias("first_run"),
        b["last_flag"].alias("last_flag"), F.when((b["last_run"] == b["n"]) & (a["last_flag"] == b["first_flag"]), a["last_run"] + b["n"]).otherwise(b["last_run"]).alias("last_run"),
        longest("longest_true", b["first_flag"]).alias("longest_true"), longest("longest_false", ~b["first_flag"]).alias("longest_false"), (a["n"] + b["n"]).alias("n"),
        (a["total"] + b["total"]).alias("total"), F.greatest(a["top"], a["total"] + b["top"]).alias("top"), F.least(a["low"], a["total"] + b["low"]).alias("low"),
        F.greatest(a["drop"], b["drop"], a["top"] - (a["total"] + b["low"])).alias("drop"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged)


def summarised(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s): each key's buckets merged in order; a key's list has an entry for each of its buckets."""
    listed = summaries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "s"))).alias("_all"))
    kind = StructType([StructField(f.name, f.dataType) for f in summaries.schema["s"].dataType])
    return listed.select(*keys, F.aggregate("_all", F.lit(None).cast(kind), lambda a, x: merge(a, x["s"]).cast(kind)).alias("s"))


def before_buckets(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _b, s, before): each bucket's summary beside that of all buckets before it (the sums' part; zeros before the first)."""
    by = Window.partitionBy(*keys).orderBy("_b")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    totals = summaries.withColumn("_total", F.coalesce(F.sum("s.total").over(earlier), F.lit(0.0)))
    top = F.coalesce(F.max(F.col("_total") + F.col("s.top")).over(earlier), F.lit(0.0))
    return totals.withColumn("before", F.struct(F.col("_total").alias("total"), F.greatest(F.lit(0.0), top).alias("top"))).drop("_total")
