"""Boosted trees fitted anew for each of many growing training sets.

The model of a stretch of time learns from all rows before it, all its trees
from the first one on: edges of bins, prior odds, draws of rows, splits and
leaves are those of its own rows. A loop of fits would read the rows for every
level of every tree of every model. Here the models grow side by side: the first
trees of all, then the second ones, so the number of jobs is that of one fit.

Rows are held in cells: a block of rows in order of time and, for each of a group
of models, the log odds of those rows that come before the model's stretch. A
level is one stage over the cells, whose tasks add up gradients and counts for
each (model, node, column, bin); the driver, which sees no row, picks the splits.
After each tree the cells are written with their new log odds. Bins are those
between the edges of any model; a table for each model takes them to its own.

Gradients are whole numbers of 2^-24, so sums are the same in any order and the
models don't depend on how rows are dealt. Splits are those with the largest
drop of the gradients' variance, leaves are Newton steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.staging import remove, shared_dir
from .boosting import Model, Tree, splits

#: Quantiles of a stretch that stand for its values where edges are chosen.
GRID = 256
#: Rows of a block, below 2^COUNT_BITS; models of a cell.
BLOCK, GROUP = 10_000, 16
#: Models that grow together: so many at most, and as many as these bytes of log odds ask for.
TOGETHER, ODDS_BYTES = 128, 1 << 29
#: Log odds that are worth a task; the most files of cells.
TASK_ODDS, FILES = 1 << 17, 64
#: The most bytes of sums that meet on the driver unmerged.
SUMS_BYTES = 1 << 26
SCALE, COUNT_BITS = 1 << 24, 14
_CELL = "first int, n int, upto binary, keys binary, bins binary, y binary, odds binary"


def drawn(keys: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """Whether a row takes part in a round: so large a share of all, by a hash of its key (splitmix64)."""
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + round_ + (seed << 20))) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < np.uint64(share * (1 << 53))


def _begun(rows: DataFrame, columns: list[str], label: str, stretch: str, starts: list[int], bins: int, settings: dict) -> tuple[list[Model], list[int]]:
    """For each start a model without trees, with the quantiles and odds of the rows before it, and the number of these."""
    shares = [(k + 0.5) / GRID for k in range(GRID)]
    found = rows.filter(F.col(stretch) < max(starts)).groupBy(stretch).agg(F.count("*").alias("n"), F.sum(label).alias("y"), *[F.percentile_approx(c, shares, 1000).alias(f"q{k}") for k, c in enumerate(columns)])
    per = sorted(found.collect(), key=lambda r: r[stretch])  # a row for each stretch
    at, n, y = (np.array([r[c] for r in per]) for c in (stretch, "n", "y"))
    edges: list[list[np.ndarray]] = [[] for _ in starts]
    for k in range(len(columns)):
        values = np.array([r[f"q{k}"] for r in per]).ravel()
        order = np.argsort(values, kind="stable")
        values, since, weights = values[order], np.repeat(at, GRID)[order], np.repeat(n, GRID)[order]
        for own, start in zip(edges, starts, strict=True):
            upto = np.cumsum(np.where(since < start, weights, 0))
            own.append(np.unique(values[np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)]))
    sizes = [int(n[at < s].sum()) for s in starts]
    means = [min(max(y[at < s].sum() / size, 1e-6), 1 - 1e-6) for s, size in zip(starts, sizes, strict=True)]
    return [Model(columns, e, float(np.log(m / (1 - m))), **settings) for e, m in zip(edges, means, strict=True)], sizes


def _cells(rows: DataFrame, models: list[Model], starts: list[int], label: str, key: str, stretch: str) -> tuple[DataFrame, np.ndarray]:
    """Cells of the rows, and (model, column and bin of any model): the model's own bin."""
    columns = models[0].columns
    edges = [np.unique(np.concatenate([m.edges[k] for m in models])) for k in range(len(columns))]
    wide = max(map(len, edges)) + 1
    table = np.zeros((len(models), len(columns), wide), np.uint16)
    for own, m in zip(table, models, strict=True):
        for k, e in enumerate(edges):
            own[k, 1 : len(e) + 1] = np.cumsum(np.isin(e, m.edges[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                at = batch[stretch].to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                upto = np.searchsorted(at[order], starts).astype(np.int32)
                bins = np.stack([np.searchsorted(e, batch[c].to_numpy(zero_copy_only=False)[order]).astype(np.uint16) for c, e in zip(columns, edges, strict=True)])
                keys, y = batch[key].to_numpy(zero_copy_only=False)[order].astype(np.int64), batch[label].to_numpy(zero_copy_only=False)[order].astype(np.uint8)
                for first in range(0, len(starts), GROUP):
                    own = upto[first : first + GROUP]
                    n = int(own.max())
                    if n:
                        odds = np.repeat(np.array([m.base for m in models[first : first + GROUP]], np.float32), own)
                        cell = {"upto": own, "keys": keys[:n], "bins": bins[:, :n], "y": y[:n], "odds": odds}
                        yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "n": pa.array([n], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in cell.items()})

    return rows.select(key, label, stretch, *columns).mapInArrow(run, _CELL), table.reshape(len(models), -1)


def _width(models: list[Model]) -> int:
    return max(len(e) for m in models for e in m.edges) + 1


def _opened(batches: Iterator[pa.RecordBatch], columns: int, wide: int) -> Iterator[tuple]:
    """Of each cell: its row, the first model, rows for each model, keys, places in a model's table (column, row), labels, and log odds for each model."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = batch.slice(i, 1)
            of = lambda name, kind, cell=cell: np.frombuffer(cell[name][0].as_buffer(), kind)
            upto, bins = of("upto", np.int32), of("bins", np.uint16).reshape(columns, -1)
            places = bins + (np.arange(columns, dtype=np.int64) * wide)[:, None]
            yield cell, cell["first"][0].as_py(), upto, of("keys", np.int64), places, of("y", np.uint8), np.split(of("odds", np.float32), np.cumsum(upto)[:-1])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each model."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for model, sums in zip(batch["model"].to_pylist(), batch["sums"], strict=True):
            more = np.frombuffer(sums.as_buffer(), np.int64)
            total[model] = total[model] + more if model in total else more
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["model", "sums"])


def _level_sums(cells: DataFrame, files: int, table, grown: list[Tree], width: int, columns: int, draw: tuple[int, float, int], last: bool) -> dict[int, np.ndarray]:
    """For each model (node, column, bin, 3): sums of gradient, curvature (where it is the last level) and count over the drawn rows, by the nodes of the growing trees' lowest level."""
    nodes = len(grown[0].features) + 1
    kinds, size = 3 if last else 2, nodes * columns * width
    offsets = np.arange(columns)[:, None] * nodes * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        tables = table.value
        for _, first, upto, keys, places, y, odds in _opened(batches, columns, tables.shape[1] // columns):
            held = np.flatnonzero(drawn(keys, *draw))
            places, y = places[:, held], y[held]
            for k, n in enumerate(np.searchsorted(held, upto)):
                if n:
                    p = 1 / (1 + np.exp(-odds[k][held[:n]].astype(np.float64)))
                    held_bins = tables[first + k][places[:, :n]]
                    slots = held_bins.astype(np.intp) + offsets
                    if nodes > 1:
                        slots += grown[first + k].leaf(held_bins).astype(np.intp) * width
                    slots = slots.ravel()
                    add = lambda v, slots=slots: np.bincount(slots, np.tile(v, columns), size).astype(np.int64)
                    both = add(np.rint((p - y[:n]) * SCALE) * (1 << COUNT_BITS) + 1)  # whole numbers below 2^53: a gradient's sum, and a count in the lowest bits
                    sums = total.setdefault(first + k, np.zeros((kinds, size), np.int64))
                    sums[0] += both >> COUNT_BITS
                    sums[1] += both & ((1 << COUNT_BITS) - 1)
                    if last:
                        sums[2] += add(np.rint(p * (1 - p) * SCALE))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["model", "sums"])

    sums = cells.mapInArrow(run, "model int, sums binary")
    if files * len(grown) * kinds * size * 8 > SUMS_BYTES:
        sums = sums.repartition(min(files, len(grown)), "model").mapInArrow(_merged, "model int, sums binary")
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # at most SUMS_BYTES, or a row for each model
        more = np.frombuffer(r.sums, np.int64)
        out[r.model] = out[r.model] + more if r.model in out else more
    return {m: _ordered(v.reshape(kinds, columns, nodes, width).swapaxes(1, 2)) for m, v in out.items()}


def _ordered(sums: np.ndarray) -> np.ndarray:
    curvature = sums[2] / SCALE if len(sums) == 3 else np.zeros(sums.shape[1:])
    return np.stack([sums[0] / SCALE, curvature, sums[1]], -1)


def _moved(cells: DataFrame, table, trees: list[Tree], columns: int) -> DataFrame:
    """The cells with the trees' values added to their log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = table.value
        for cell, first, upto, _, places, _, odds in _opened(batches, columns, tables.shape[1] // columns):
            after = []
            for k, n in enumerate(upto):
                tree, bins = trees[first + k], np.zeros((columns, n), np.uint16)
                for f in np.unique(tree.features):
                    bins[f] = tables[first + k][places[f, :n]]
                after.append((odds[k] + np.take(tree.values, tree.leaf(bins))).astype(np.float32))
            at = cell.schema.get_field_index("odds")
            yield cell.set_column(at, "odds", pa.array([np.concatenate(after).tobytes()], pa.binary()))

    return cells.mapInArrow(run, _CELL)


def _grown(tree: Tree, sums: np.ndarray, least: int) -> Tree:
    features, cuts = splits(sums, least, weight=2, ridge=1e-9)
    return replace(tree, features=np.append(tree.features, features), cuts=np.append(tree.cuts, cuts))


def _leaves(tree: Tree, sums: np.ndarray, step: float) -> Tree:
    """The tree with its values: Newton steps of the leaves that its last splits make."""
    nodes = len(sums)
    left = np.stack([np.cumsum(sums[k, f], 0)[min(c, sums.shape[2] - 1)] for k, f, c in zip(range(nodes), tree.features[-nodes:], tree.cuts[-nodes:], strict=True)])
    leaves = np.stack([left, sums[:, 0].sum(1) - left], 1).reshape(-1, 3)
    return replace(tree, values=np.where(leaves[:, 1] > 1e-6, -step * leaves[:, 0] / np.maximum(leaves[:, 1], 1e-6), 0.0))


def _together(rows: DataFrame, models: list[Model], starts: list[int], sizes: list[int], label: str, key: str, stretch: str, rounds: int, share: float, seed: int) -> list[Model]:
    spark, columns, width, path = rows.sparkSession, len(models[0].columns), _width(models), f"{shared_dir(rows.sparkSession)}/odds-{uuid.uuid4().hex}"
    before = rows.filter(F.col(stretch) < max(starts)).coalesce(-(-max(sizes) // BLOCK))
    cells, table = _cells(before, models, starts, label, key, stretch)
    files = min(FILES, -(-sum(sizes) // TASK_ODDS))
    cells.repartition(files).write.parquet(f"{path}/0")
    sent = spark.sparkContext.broadcast(table)
    try:
        for k in range(rounds):
            cells = spark.read.schema(_CELL).parquet(f"{path}/{k}")
            trees = [Tree(s, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for s in starts]
            for level in range(models[0].depth):
                last = level == models[0].depth - 1
                sums = _level_sums(cells, files, sent, trees, width, columns, (k, share, seed), last)
                nothing = np.zeros((1 << level, columns, width, 3))
                sums = [sums.get(m, nothing) for m in range(len(models))]
                trees = [_grown(t, s, m.least) for t, s, m in zip(trees, sums, models, strict=True)]
            trees = [_leaves(t, s, m.step) for t, s, m in zip(trees, sums, models, strict=True)]
            models = [replace(m, trees=[*m.trees, t]) for m, t in zip(models, trees, strict=True)]
            if k + 1 < rounds:
                _moved(cells, sent, trees, columns).write.parquet(f"{path}/{k + 1}")
            remove(spark, f"{path}/{k}")
    finally:
        sent.destroy()
        remove(spark, path)
    return models


def refitted(rows: DataFrame, columns: list[str], label: str, key: str, stretch: str, starts: list[int], rounds: int, bins: int = 32, share: float = 1.0, seed: int = 0, **settings: float) -> dict[int, Model]:
    """For each start a model of so many trees, fitted to all rows of the stretches before it.

    rows are staged, with labels 0 and 1, whole numbers as keys, and at least one
    row before the first start. A tree is fitted to a share of a model's rows,
    drawn by key and round. bins: at most 256.
    """
    starts = sorted(starts)
    models, sizes = _begun(rows, columns, label, stretch, starts, bins, settings)
    out: dict[int, Model] = {}
    while len(out) < len(starts):
        at = end = len(out)
        while end < len(starts) and end - at < TOGETHER and (end == at or 4 * sum(sizes[at : end + 1]) <= ODDS_BYTES):
            end += 1
        out |= zip(starts[at:end], _together(rows, models[at:end], starts[at:end], sizes[at:end], label, key, stretch, rounds, share, seed), strict=True)
    return out


def scored_at(models: dict[int, Model], rows: DataFrame, stretch: str, name: str = "prob") -> DataFrame:
    """rows of the models' stretches with the probability by the model of each row's stretch."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, odds = batch[stretch].to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for s in np.unique(at):
                own = np.flatnonzero(at == s)
                odds[own] = models[int(s)].margins(models[int(s)].bins(batch.take(pa.array(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-odds)))], names=[*names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))
