"""The anchored clock: a sequential fold that no window expresses, in parallel over time buckets.

A price is accepted if it lies more than a threshold from the last accepted one,
so a row's outcome depends on all rows of its key before it. Two passes make that
parallel. The first turns a bucket into a function from the anchor at its start
to that at its end. The first accepted row of a bucket is always one that sets
a new high or low of the bucket's prices, and once these are over two thresholds
apart every anchor has met one; so the function is a short list: such a price and
where the chain of accepted prices that begins there ends. Borders are then settled
in order, a few numbers a bucket, and the second pass runs all buckets from their
known starts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.staging import staged
from .ordered import DAY_US, time_bucket


def accepted(values: np.ndarray, anchor: float | None, threshold: float) -> np.ndarray:
    """Places of the accepted values, in order.

    A value that has moved from an accepted neighbour is accepted, so whole runs
    of moves are taken at once; where a run ends, the next value far from the
    anchor is looked for in stretches of doubling length.
    """
    stops = np.append(np.flatnonzero(~(np.abs(np.diff(values)) > threshold)), len(values) - 1)
    at, found = 0, []
    while at < len(values):
        if anchor is not None:
            width = 16
            while at < len(values):
                far = np.flatnonzero(np.abs(values[at : at + width] - anchor) > threshold)
                if len(far):
                    at += int(far[0])
                    break
                at, width = at + width, 2 * width
            else:
                break
        last = int(stops[np.searchsorted(stops, at)])
        found.append(np.arange(at, last + 1))
        anchor, at = values[last], last + 1
    return np.concatenate(found) if found else np.empty(0, np.int64)


def bucket_ends(values: np.ndarray, us: np.ndarray, threshold: float) -> list[tuple[float, float, int]]:
    """(price, anchor, since) of each price that may be a bucket's first accepted one: what the chain from there ends with."""
    high, low = np.maximum.accumulate(values), np.minimum.accumulate(values)
    new = np.append(True, (high[1:] > high[:-1]) | (low[1:] < low[:-1]))
    met = np.append(False, (high - low)[:-1] > 2.001 * threshold)
    out = []
    for k in np.flatnonzero(new & ~met):
        chain = accepted(values[k:], None, threshold)
        out.append((float(values[k]), float(values[k + chain[-1]]), int(us[k + chain[-1]])))
    return out


def _prices(table: pa.Table, price: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The table in order, the places of its prices, those, and all times."""
    table = table.sort_by([("us", "ascending"), ("seq", "ascending")])
    values = table[price].to_numpy().astype(float)
    known = np.flatnonzero(~np.isnan(values))
    return table, known, values[known], table["us"].to_numpy()


def _summarise(keys: list[str], price: str, threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, known, values, us = _prices(table, price)
        ends = bucket_ends(values, us[known], threshold) if len(known) else [(None, None, None)]
        first, anchor, since = (list(c) for c in zip(*ends, strict=True))
        columns = [pa.array([k.as_py()] * len(ends), k.type) for k in key]
        return pa.table([*columns, pa.array(range(len(ends)), pa.int32()), pa.array(first, pa.float64()), pa.array(anchor, pa.float64()), pa.array(since, pa.int64())], names=[*keys, "_b", "_entry", "_first", "_anchor", "_since"])

    return run


def _settle(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """A key's buckets with the anchor and time that each begins with."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_b", "ascending"), ("_entry", "ascending")])
        anchor, since, begun, at = None, None, [], None
        for place, (b, entry, price, end, end_since) in enumerate(zip(*(table[c].to_pylist() for c in ("_b", "_entry", "_first", "_anchor", "_since")), strict=True)):
            if b != at or not entry:
                at, start, open_ = b, anchor, True
                begun.append((place, anchor, since))
            if open_ and price is not None and (start is None or abs(price - start) > threshold):
                anchor, since, open_ = end, end_since, False
        places, anchors, times = zip(*begun, strict=True)
        kept = table.take(pa.array(places)).drop_columns(["_entry", "_first", "_anchor", "_since"])
        return kept.append_column("_anchor", pa.array(anchors, pa.float64())).append_column("_since", pa.array(times, pa.int64()))

    return run


def anchored_stale_seconds(df: DataFrame, keys: list[str], price: str, threshold: float, never: float = 999.0, name: str = "stale_seconds", width_us: int = DAY_US) -> DataFrame:
    """df with the time since the price last left the last accepted price by more than threshold, over all of a key's rows.

    df: seq, us (neither null), price and keys; it is read twice. A task holds a
    key's rows of one bucket of the given width. A null price is passed over.
    """
    rows = df.withColumn("_b", time_bucket(width=width_us))
    of_keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    ends = rows.select(*keys, "_b", "us", "seq", F.col(price).cast("double").alias(price)).groupBy(*keys, "_b").applyInArrow(_summarise(keys, price, threshold), f"{of_keys}, _b long, _entry int, _first double, _anchor double, _since long")
    starts = staged(ends.groupBy(*keys).applyInArrow(_settle(threshold), f"{of_keys}, _b long, _anchor double, _since long"), "anchors")
    starts = starts.select(*[F.col(c).alias(f"_of_{c}") for c in [*keys, "_b"]], "_anchor", "_since")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_b"]]
    placed = rows.join(starts, same).drop(*[f"_of_{c}" for c in [*keys, "_b"]])

    def run(table: pa.Table) -> pa.Table:
        table, known, values, us = _prices(table, price)
        anchor, since = table["_anchor"][0].as_py(), table["_since"][0].as_py()
        last = np.full(len(us), -1, np.int64)
        taken = known[accepted(values, anchor, threshold)] if len(known) else known
        last[taken] = taken
        last = np.maximum.accumulate(last)
        begun = np.where(last >= 0, us[np.maximum(last, 0)], since if since is not None else 0)
        stale = np.where((last >= 0) | (since is not None), (us - begun) / 1e6, never)
        return table.drop_columns(["_b", "_anchor", "_since"]).append_column(name, pa.array(stale))

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return placed.groupBy(*keys, "_b").applyInArrow(run, schema)
