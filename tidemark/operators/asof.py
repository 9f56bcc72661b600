"""Nearest-in-time, as-of and interval operators.

What looks back in time is a step of ``over_time``: however many horizons a query
asks for, the rows are shuffled once by key and time bucket, and a table with a
row for each bucket carries the last known values across the borders.

All frames grow: they begin with a bucket's first row (or its last, in descending
order) and end at a distance from the current row. Spark takes each row into such
a frame once, so work grows with the rows however many of them a window holds;
what lies within a window is the difference of two growing sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import DAY_US, carried_values, time_bucket, with_lookback

#: The window of a key and bucket to columns over it.
Windowed = Callable[[WindowSpec], dict[str, Column]]


def _nothing(_: WindowSpec) -> dict[str, Column]:
    return {}


@dataclass(frozen=True)
class Step:
    """Columns made of what lies behind a row, and the columns over windows that they are made of.

    ordered: windows in order of us and seq; until: of us; since: of us backwards.
    Later ones may use earlier ones. The windows of all steps that need an order
    share its sort; the order of us and seq does for us as well.
    """

    made: dict[str, Column]
    ordered: Windowed = _nothing
    until: Windowed = _nothing
    since: Windowed = _nothing


def over_time(df: DataFrame, keys: list[str], lookback_us: int, steps: list[Step], known: dict[str, str] | None = None, width_us: int | None = None, parts: int | None = None) -> DataFrame:
    """df (us, seq, ...) with the columns of the steps, each of which sees a row's key for the lookback before the row.

    known: name -> value adds the last non-null value at or before the row by (us,
    seq), however old. width_us: a bucket's width; a day, or four lookbacks if
    that is more. parts: the partitions that buckets are dealt to, else Spark's
    choice, which goes by bytes as shuffled; ordered.bucket_parts gives both.
    """
    width = width_us or max(DAY_US, 4 * lookback_us)
    rows, by = with_lookback(df, lookback_us, width=width), Window.partitionBy(*keys, "_b")
    if parts:
        rows = rows.repartition(parts, *keys, "_b")
    upto = by.orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = {f"_seen_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in (known or {}).items()}
    over: list[str] = []
    for phase in ([lambda _: seen, *[s.ordered for s in steps]], [s.until for s in steps], [s.since for s in steps]):
        columns = {n: c for windowed in phase for n, c in windowed(by).items()}
        rows = rows.withColumns(columns)
        over += [n for n in columns if n not in seen]
    rows = rows.filter("not _copy").withColumns({n: c for s in steps for n, c in s.made.items()}).drop("_copy", *over)
    if known:
        ends = df.withColumn("_b", time_bucket(width=width))
        carried = carried_values(ends, keys, ["us", "seq"], {f"_end_{n}": F.col(v) for n, v in known.items()})
        rows = rows.join(carried, [*keys, "_b"]).withColumns({n: F.coalesce(f"_seen_{n}", f"_end_{n}") for n in known})
        rows = rows.drop(*[f"_{k}_{n}" for k in ("seen", "end") for n in known])
    return rows.drop("_b")


def lookback(horizon_us: int) -> int:
    """How far back the value nearest to a horizon ago may lie."""
    return horizon_us + horizon_us // 2


def _until(by: WindowSpec, back_us: int) -> WindowSpec:
    """The rows of the bucket at or before us - back."""
    return by.orderBy("us").rangeBetween(Window.unboundedPreceding, -back_us)


def _since(by: WindowSpec, back_us: int) -> WindowSpec:
    """The rows of the bucket after us - back."""
    return by.orderBy(F.col("us").desc()).rangeBetween(Window.unboundedPreceding, back_us - 1)


def nearest(value: str, horizons_us: dict[str, int], inclusive: bool = True) -> Step:
    """For each name and horizon the value whose time is nearest to us - horizon, within half a horizon; ties go to the earlier.

    The tolerance's edge counts if inclusive. Of rows at one time the first by
    seq that has a value is looked up.
    """

    known = F.col(value).isNotNull()
    point, first_of_time = F.struct("us", F.col(value).alias("v")), F.when(known, F.struct(F.col("us"), -F.col("seq")))
    made = {}
    for n, h in horizons_us.items():
        e, later, target = F.col(f"_e_{n}"), F.col(f"_l_{n}"), F.col("us") - h
        before, after = (F.when(x.between(0, h // 2 if inclusive else (h - 1) // 2), x) for x in (target - e["us"], later["us"] - target))
        made[n] = F.when(before.isNotNull() & (after.isNull() | (before <= after)), e["v"]).when(after.isNotNull(), later["v"])
    return Step(
        made,
        until=lambda by: {f"_e_{n}": F.max_by(point, first_of_time).over(_until(by, h)) for n, h in horizons_us.items()},
        since=lambda by: {f"_l_{n}": F.min_by(point, F.when(known, F.struct("us", "seq"))).over(_since(by, h)) for n, h in horizons_us.items()},
    )


def within(counted: Column, window_us: int, by: WindowSpec) -> Column:
    """Sum of counted over (us - window, us]."""
    return F.coalesce(F.sum(counted).over(_until(by, 0)), F.lit(0)) - F.coalesce(F.sum(counted).over(_until(by, window_us)), F.lit(0))


def nearest_before(df: DataFrame, keys: list[str], value: str, horizon_us: int, name: str, inclusive: bool = True) -> DataFrame:
    """df with the value nearest to a horizon ago."""
    return over_time(df, keys, lookback(horizon_us), [nearest(value, {name: horizon_us}, inclusive)])


def momentum(df: DataFrame, keys: list[str], value: str, horizons_us: dict[str, int], inclusive: bool = True, width_us: int | None = None) -> DataFrame:
    """For each name and horizon: last known value minus the one a horizon ago, rounded to 6. width_us: as for over_time; ordered.bucket_width gives one."""
    then = nearest(value, {f"_then_{n}": h for n, h in horizons_us.items()}, inclusive)
    looked = over_time(df, keys, max(map(lookback, horizons_us.values())), [then], {"_now": value}, width_us)
    moved = looked.withColumns({n: F.round(F.col("_now") - F.col(f"_then_{n}"), 6) for n in horizons_us})
    return moved.drop("_now", *[f"_then_{n}" for n in horizons_us])


def percent_change(now: str, then: str) -> Column:
    return F.when(F.col(then) > 0, (F.col(now) - F.col(then)) / F.col(then) * 100)


def trend(df: DataFrame, keys: list[str], value: str, horizons_us: dict[str, int], width_us: int | None = None) -> DataFrame:
    """Change in percent against the value a horizon ago (strict tolerance), as of the last known value."""
    then = nearest(value, {f"_then_{n}": h for n, h in horizons_us.items()}, inclusive=False)
    looked = over_time(df, keys, max(map(lookback, horizons_us.values())), [then], {"_now": value}, width_us)
    moved = looked.withColumns({n: percent_change("_now", f"_then_{n}") for n in horizons_us})
    return moved.drop("_now", *[f"_then_{n}" for n in horizons_us])


def volatility(value: str, window_us: int, period_us: int, name: str, least: tuple[int, int, int] = (0, 0, 3), history_us: int | None = None) -> Step:
    """Population deviation of the percent returns within the window, scaled to a period.

    Both ends of a return lie in (now - window, now]: the window's sums less its
    first value's return. Null below the least values in (now - history, now], values
    in the window, and returns; null as well where the row has no value.
    """

    v, before = F.col(value), F.col("_before")
    r, one = F.when(v.isNotNull() & (before > 0), (v - before) / before * 100), v.isNotNull().cast("int")
    count, f = F.col("_n") - F.col("_f").isNotNull().cast("int"), F.coalesce("_f", F.lit(0.0))
    some = F.nullif(count, F.lit(0))
    variance = F.greatest((F.col("_q") - f * f) / some - F.pow((F.col("_s") - f) / some, 2), F.lit(0.0))
    enough = v.isNotNull() & (F.col("_held") >= least[0]) & (F.col("_values") >= least[1]) & (count >= least[2])
    return Step(
        {name: F.when(enough, F.sqrt(variance) * F.sqrt(count * (period_us / window_us)))},
        ordered=lambda by: {"_before": F.last(value, ignorenulls=True).over(by.orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1))},
        until=lambda by: {"_n": within(r.isNotNull().cast("int"), window_us, by), "_s": within(r, window_us, by), "_q": within(r * r, window_us, by), "_values": within(one, window_us, by), "_held": within(one, history_us or window_us, by)},
        since=lambda by: {"_f": F.min_by(F.struct(r.alias("r")), F.when(v.isNotNull(), F.struct("us", "seq"))).over(_since(by, window_us))["r"]},
    )


def realized_volatility(df: DataFrame, keys: list[str], value: str, window_us: int, period_us: int, name: str, least: tuple[int, int, int] = (0, 0, 3), history_us: int | None = None, width_us: int | None = None) -> DataFrame:
    """df with the volatility; what lies outside the window and the history isn't read."""
    return over_time(df, keys, max(window_us, history_us or 0), [volatility(value, window_us, period_us, name, least, history_us)], width_us=width_us)


def asof_join(df: DataFrame, states: DataFrame, at: str, keys: list[str], columns: list[str], width_us: int, us: str = "us", parts: int | None = None) -> DataFrame:
    """df with the columns of the latest state at or before us, by a merge of rows and states in time buckets.

    Rows and states of a key and bucket are sorted together, and each row takes
    the last state that it meets; a table with a row for each bucket carries the
    state of the buckets before. Neither side has to be the smaller one. states
    has one row for each key and time. A null us meets no state. parts: as for over_time.
    """
    left = df.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(us).alias("_at"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"), F.lit(None).cast(states.select(F.struct(*columns)).schema[0].dataType).alias("_state"))
    right = states.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_state"))
    both, by = left.unionByName(right).withColumn("_b", time_bucket("_at", width_us)), [f"_of_{k}" for k in keys]
    carried = carried_values(both.select(*by, "_b", "_at", "_state"), by, ["_at"], {"_carried": F.col("_state")})
    met = Window.partitionBy(*by, "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.repartition(parts, *by, "_b") if parts else both
    rows = dealt.withColumn("_met", F.last("_state", ignorenulls=True).over(met)).filter("_kind = 1")
    same = rows["_b"].eqNullSafe(carried["_b"])
    for k in by:
        same = same & rows[k].eqNullSafe(carried[k])
    state = F.when(F.col("_at").isNotNull(), F.coalesce("_met", "_carried"))
    return rows.join(carried, same).withColumn("_state", state).select("_row.*", *[F.col("_state")[c].alias(c) for c in columns])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], ids: list[str], left_us: str, right_us: str, within_us: int, columns: list[str]) -> DataFrame:
    """Left rows (told apart by ids) with the earliest right row of the key in [left_us, left_us + within], else nulls.

    An equi-join on time buckets: a right row stands in its own bucket and the one before.
    """
    div = lambda c: F.call_function("div", c, F.lit(within_us))
    events = right.select(*keys, F.col(right_us).alias("_at"), F.struct(*columns).alias("_hit"))
    events = events.withColumn("_b", F.explode(F.array(div(F.col("_at")), div(F.col("_at")) - 1)))
    joined = left.withColumn("_b", div(F.col(left_us))).join(events, [*keys, "_b"], "left")
    fits = (F.col("_at") >= F.col(left_us)) & (F.col("_at") <= F.col(left_us) + within_us)
    rest = [c for c in left.columns if c not in ids]
    hit = F.min_by("_hit", F.when(fits, F.col("_at")))
    return joined.groupBy(*ids).agg(*[F.first(c).alias(c) for c in rest], hit.alias("_hit")).select(*left.columns, *[F.col("_hit")[c].alias(c) for c in columns])
