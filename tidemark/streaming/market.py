"""Streams of ticks: bars, sessions, deduplication, late settlements, state by asset."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import accepted

DELAY = "5 minutes"


def events_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """ST1: the events table as a file stream with event time ts.

    Files have no order in event time, so all that have landed are one batch,
    unless files_per_batch is given: then a watermark's delay has to cover their
    disorder, or it drops rows as late.
    """
    schema = spark.read.parquet(path).schema
    # a pattern: a stream takes no plain path of a single file
    source = spark.readStream.schema(schema)
    raw = (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset"), "user_id", (F.lit(100.0) + F.col("value")).alias("price"))


def deduplicated(ticks: DataFrame, key: str = "seq") -> DataFrame:
    """ST2."""
    return ticks.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark([key])


def period_bars(ticks: DataFrame, width: str = "6 hours") -> DataFrame:
    """ST3: open, high, low, close of each asset and period, once the watermark has passed it."""
    bars = ticks.withWatermark("ts", DELAY).groupBy(F.window("ts", width), "asset").agg(
        F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "seq")).alias("close"), F.count("*").alias("n"),
    )
    return bars.select(F.col("window.start").alias("start"), "asset", "open", "high", "low", "close", "n")


def sliding_momentum(ticks: DataFrame, width: str = "6 hours", step: str = "2 hours") -> DataFrame:
    """ST4: last less first price of sliding windows."""
    moved = ticks.withWatermark("ts", DELAY).groupBy(F.window("ts", width, step), "asset").agg((F.max_by("price", F.struct("ts", "seq")) - F.min_by("price", F.struct("ts", "seq"))).alias("momentum"), F.count("*").alias("n"))
    return moved.select(F.col("window.start").alias("start"), "asset", F.round("momentum", 6).alias("momentum"), "n")


def collection_sessions(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST7: sessions of an asset; a pause longer than gap ends one."""
    s = ticks.withWatermark("ts", DELAY).groupBy(F.session_window("ts", gap), "asset").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "asset", "n")


def throttled(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """ST8: the first tick of each asset and tumbling slot."""
    first = ticks.withWatermark("ts", DELAY).groupBy(F.window("ts", width), "asset").agg(F.min_by(F.struct("seq", "price"), F.struct("ts", "seq")).alias("t"))
    return first.select(F.col("window.start").alias("start"), "asset", "t.seq", "t.price")


def settlement_join(rolls: DataFrame, settled: DataFrame, within: str = "300 seconds") -> DataFrame:
    """ST6: roll-overs (ticker, roll_ts) with results (ticker, settle_ts, result) that arrive in time, else null once the watermark passes."""
    left, right = rolls.withWatermark("roll_ts", DELAY).alias("r"), settled.withWatermark("settle_ts", DELAY).alias("s")
    near = F.expr(f"r.ticker = s.ticker AND s.settle_ts >= r.roll_ts AND s.settle_ts <= r.roll_ts + INTERVAL {within}")
    return left.join(right, near, "leftOuter").select("r.ticker", "r.roll_ts", "s.settle_ts", "s.result")


FRAME = 10_000
SLOT_SECONDS = 21_600
#: Rows of one slot, as arrays: a frame's part of it.
PART = "seq array<long>, us array<long>, price array<double>"
CARRY = "period long, anchor double, since long, told boolean"


class SlotState(StatefulProcessor):
    """An asset's rows, held by time slot until the watermark has passed the slot, then worked in order.

    Rows may come in any order and over any batches that the watermark's delay
    spans. What a frame holds of a slot is one entry of a map in the state store,
    so that no batch and no asset is gathered: a task holds a frame, or the rows
    of one slot. One carry row goes from slot to slot.
    """

    def __init__(self, slot_seconds: int) -> None:
        self.slot_us = slot_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot long, part long", PART)
        self.counts = handle.getMapState("counts", "slot long", "n long")
        self.carry = handle.getValueState("carry", CARRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            us = frame["ts"].to_numpy("datetime64[us]").astype(np.int64)
            slots = us // self.slot_us
            for slot in np.unique(slots).tolist():
                at = slots == slot
                n = self.counts.getValue((slot,))[0] if self.counts.containsKey((slot,)) else 0
                if not n:
                    self.handle.registerTimer((slot + 1) * self.slot_us // 1000)
                columns = frame["seq"].to_numpy()[at], us[at], frame["price"].to_numpy(np.float64)[at]
                self.parts.updateValue((slot, n), tuple(c.tolist() for c in columns))
                self.counts.updateValue((slot,), (n + 1,))
        yield from ()

    def _taken(self, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seq, us, price) of a slot in order, which the state then forgets."""
        (n,) = self.counts.getValue((slot,))
        parts = [self.parts.getValue((slot, k)) for k in range(n)]
        for k in range(n):
            self.parts.removeKey((slot, k))
        self.counts.removeKey((slot,))
        seq, us, price = (np.concatenate([np.array(p[c], kind) for p in parts]) for c, kind in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((seq, us))
        return seq[order], us[order], price[order]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000  # the first timer of a batch settles all that is due
        carry = tuple(self.carry.get()) if self.carry.exists() else (None, None, None, False)
        for slot in sorted(s for (s,) in self.counts.keys() if s < mark // self.slot_us):  # a few: those that wait
            frames, carry = self.settle(key[0], *self._taken(slot), carry)
            yield from frames
        frames, carry = self.passed(key[0], mark, carry)
        yield from frames
        self.carry.update(carry)

    def settle(self, asset: str, seq: np.ndarray, us: np.ndarray, price: np.ndarray, carry: tuple) -> tuple[list[pd.DataFrame], tuple]:
        """What a slot's rows give after all rows before them, and the carry after it."""
        raise NotImplementedError

    def passed(self, asset: str, mark: int, carry: tuple) -> tuple[list[pd.DataFrame], tuple]:
        """What the watermark's reaching of mark gives by itself."""
        return [], carry

    def close(self) -> None:
        pass


def _accepted(us: np.ndarray, price: np.ndarray, anchor: float | None, threshold: float) -> np.ndarray:
    """Places of the rows whose price moved from the one accepted before it by more than threshold."""
    known = np.flatnonzero(~np.isnan(price))
    return known[accepted(price[known], anchor, threshold)] if len(known) else known


class AssetState(SlotState):
    """ST5: roll-overs of an asset and how long its price has stood."""

    def __init__(self, slot_seconds: int, period_seconds: int, threshold: float) -> None:
        super().__init__(slot_seconds)
        self.period_us, self.threshold = period_seconds * 1_000_000, threshold

    def settle(self, asset, seq, us, price, carry):
        period, anchor, since, told = carry
        taken = _accepted(us, price, anchor, self.threshold)
        last = np.full(len(us), -1)
        last[taken] = taken
        last = np.maximum.accumulate(last)
        begun = np.where(last >= 0, us[np.maximum(last, 0)], since or 0)
        stood = np.where((last >= 0) | (since is not None), (us - begun) / 1e6, 999.0)
        periods = us // self.period_us
        rolled = np.diff(periods, prepend=periods[0] if period is None else period) != 0
        whole = pd.DataFrame({"asset": asset, "seq": seq, "period": periods, "rolled": rolled, "stale_seconds": stood})
        if len(taken):
            anchor, since = float(price[taken[-1]]), int(us[taken[-1]])
        return [whole[at : at + FRAME] for at in range(0, len(whole), FRAME)], (int(periods[-1]), anchor, since, told)


def stateful_ticks(ticks: DataFrame, period_seconds: int = 21_600, threshold: float = 0.001, slot_seconds: int = SLOT_SECONDS, delay: str = DELAY) -> DataFrame:
    """ST5: every row of the slots that the watermark has passed; needs the RocksDB state store.

    Rows later than the delay are dropped, as in any stream with a watermark; a
    replay of unordered files takes a delay that covers their disorder.
    """
    return ticks.withWatermark("ts", delay).groupBy("asset").transformWithStateInPandas(statefulProcessor=AssetState(slot_seconds, period_seconds, threshold), outputStructType="asset string, seq long, period long, rolled boolean, stale_seconds double", outputMode="append", timeMode="EventTime")


class StaleFeed(SlotState):
    """ST9: an alert for each accepted price that stood longer than a limit, by a timer where no row ends it.

    An alert is due once all rows up to its limit are known: when the watermark
    passes the slot that the limit lies in. If batches are whole, it is due with
    the row that ends it, or when the watermark passes the limit.
    """

    def __init__(self, slot_seconds: int, limit_seconds: float, threshold: float, whole: bool = False) -> None:
        super().__init__(slot_seconds)
        self.limit_us, self.threshold, self.whole = int(limit_seconds * 1_000_000), threshold, whole

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from super().handleInputRows(key, rows, timerValues)
        if self.whole:
            carry = tuple(self.carry.get()) if self.carry.exists() else (None, None, None, False)
            for slot in sorted(s for (s,) in self.counts.keys()):
                frames, carry = self.settle(key[0], *self._taken(slot), carry)
                yield from frames
            if carry[2] is not None and not carry[3]:
                self.handle.registerTimer((carry[2] + self.limit_us) // 1000 + 1)
            self.carry.update(carry)

    def _alerts(self, asset: str, times: np.ndarray) -> list[pd.DataFrame]:
        return [pd.DataFrame({"asset": [asset] * len(times), "since_us": times, "alert_us": times + self.limit_us})] if len(times) else []

    def settle(self, asset, seq, us, price, carry):
        period, anchor, since, told = carry
        taken = _accepted(us, price, anchor, self.threshold)
        if not len(taken):
            return [], carry
        times = us[taken] if since is None or told else np.append(since, us[taken])
        stale = times[:-1][np.diff(times) > self.limit_us]
        return self._alerts(asset, stale), (period, float(price[taken[-1]]), int(times[-1]), False)

    def passed(self, asset, mark, carry):
        period, anchor, since, told = carry
        if since is None or told:
            return [], carry
        due = since + self.limit_us + 1 if self.whole else ((since + self.limit_us) // self.slot_us + 1) * self.slot_us
        if due > mark:
            self.handle.registerTimer(-(-due // 1000))
            return [], carry
        return self._alerts(asset, np.array([since])), (period, anchor, since, True)


def stale_alerts(ticks: DataFrame, seconds: float = 60.0, threshold: float = 0.001, slot_seconds: int = SLOT_SECONDS, delay: str = DELAY, whole: bool = False) -> DataFrame:
    """ST9: asset, since_us, alert_us; in event time, so an asset that falls silent is told of by the others' progress.

    whole: each batch holds all rows up to its last one, as where all that has
    landed is one batch, so that its rows need not wait for the watermark.
    """
    return ticks.withWatermark("ts", delay).groupBy("asset").transformWithStateInPandas(statefulProcessor=StaleFeed(slot_seconds, seconds, threshold, whole), outputStructType="asset string, since_us long, alert_us long", outputMode="append", timeMode="EventTime")


def run_available(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """ST10: all that has landed, to Parquet below folder with a checkpoint; the written rows, read by spark."""
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def raw_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a file stream, all columns as they are."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).parquet(f"{path[:-1]}[{path[-1]}]")


@dataclass(frozen=True)
class SlotBatches:
    """A sink that applies a batch operator to the time slots that the watermark has passed, each once and whole.

    Rows (seq, us and a key among them) land in a table by slot. When slots close,
    ``make`` gets their rows, those of the lookback before them, and each key's last
    row with a value, however old, and returns the closed slots' rows. What a
    batch writes (landed rows, results, carry, progress) stands in folders under
    its number, so a batch that is run again writes the same again. Rows of slots
    that are closed already are late and left out.
    """

    folder: str
    make: Callable[[DataFrame], DataFrame]
    key: str
    value: str
    slot_us: int
    lookback_us: int
    delay_us: int

    def _before(self, spark: SparkSession, name: str, number: int, schema: str) -> DataFrame:
        """What the last batch before this one wrote of a kind."""
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/batch={number - 1}") if number else spark.createDataFrame([], schema)

    def write(self, batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        last = self._before(spark, "progress", number, "until long, mark long").head()
        begun, mark = last or (None, None)
        slot = F.call_function("div", F.col("us"), F.lit(self.slot_us))
        rows = batch.withColumn("slot", slot)
        (rows if begun is None else rows.filter(F.col("slot") >= begun)).write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/landed/batch={number}")
        landed = spark.read.schema(f"{kind}, slot long, batch int").parquet(f"{self.folder}/landed").filter(F.col("batch") <= number)
        top = landed.filter(F.col("batch") == number).agg(F.max("us")).first()[0]
        mark = max(x for x in (mark, top and top - self.delay_us, 0) if x is not None)
        until = mark // self.slot_us
        closing = F.lit(True) if begun is None else F.col("slot") >= begun
        reach = F.lit(True) if begun is None else F.col("slot") >= (begun * self.slot_us - self.lookback_us) // self.slot_us
        carry = self._before(spark, "carry", number, kind)
        known = landed.filter((F.col("slot") < until) & reach).drop("slot", "batch").unionByName(carry).dropDuplicates(["seq"])
        self.make(known).withColumn("slot", slot).filter(closing & (F.col("slot") < until)).drop("slot").write.mode("overwrite").parquet(f"{self.folder}/made/batch={number}")
        latest = F.max_by(F.struct(*batch.columns), F.when(F.expr(self.value), F.struct("us", "seq"))).alias("r")
        known.groupBy(self.key).agg(latest).filter("r is not null").select("r.*").write.mode("overwrite").parquet(f"{self.folder}/carry/batch={number}")
        spark.createDataFrame([(until, mark)], "until long, mark long").write.mode("overwrite").parquet(f"{self.folder}/progress/batch={number}")

    def run_available(self, stream: DataFrame) -> DataFrame:
        """All that has landed, batch by batch; the rows that were made."""
        q = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return stream.sparkSession.read.parquet(f"{self.folder}/made").drop("batch")


def many_sinks(stream: DataFrame, checkpoint: str, sinks: dict[str, tuple], once: bool = True):
    """ST10: each micro-batch to several tables: name -> (path, function of the batch). A batch's folder is overwritten if it is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, make in sinks.values():
            make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
