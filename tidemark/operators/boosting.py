"""Boosted trees that go on from one stretch of time to the next.

A model for each of many growing training sets, fitted anew, costs the sum of
all of them. Here a model is continued: it keeps its trees and adds new ones that
fit what its probabilities miss on the rows that have come since, so each row is
learned from once and a stretch costs its own rows. Trees carry the stretch that
made them; the model as of a stretch is all trees up to it, so one pass scores
every row by the model of its own time.

Rows are binned by fixed edges, once if ``binned`` has put the bins beside them.
A tree grows level by level: tasks add up gradients, curvatures and counts for
each (node, feature, bin), and the driver, which sees no row, merges these sums
and picks each node's best split. So a level is one stage of a bounded number of
tasks: the many jobs of many small stretches cost little more than their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

RIDGE = 1.0
#: A column of a row's bins, a byte for each of the model's columns.
BINS = "_bins"
#: The most tasks whose sums meet on the driver.
TASKS = 64


@dataclass(frozen=True)
class Tree:
    """A complete tree over bins: a node sends bins at or below its cut to the left (all of them where it has no split)."""

    stretch: int
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row (a column of bins), from 0; of a tree that still grows, the node of its lowest level."""
        at, levels = np.zeros(bins.shape[1], np.uint8), (len(self.features) + 1).bit_length() - 1
        for level in range(levels):
            first, right = (1 << level) - 1, np.zeros(len(at), bool)
            for k in range(1 << level):
                right |= (at == k) & (bins[self.features[first + k]] > int(self.cuts[first + k]))
            at = 2 * at + right
        return at


@dataclass(frozen=True)
class Model:
    columns: list[str]
    edges: list[np.ndarray]
    base: float
    depth: int = 3
    step: float = 0.1
    least: int = 10
    trees: list[Tree] = field(default_factory=list)

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """(column, row): bins as bytes; those beside the rows, if there are any."""
        if BINS in batch.schema.names:
            return np.ascontiguousarray(np.frombuffer(b"".join(batch[BINS].to_pylist()), np.uint8).reshape(batch.num_rows, len(self.columns)).T)
        return np.stack([np.searchsorted(e, batch[c].to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for c, e in zip(self.columns, self.edges, strict=True)])

    def margins(self, bins: np.ndarray, stretch: np.ndarray | None = None) -> np.ndarray:
        """Log odds of each row; by the trees up to its stretch, if given."""
        out = np.full(bins.shape[1], self.base)
        for upto in [None] if stretch is None else np.unique(stretch):
            rows = slice(None) if upto is None or (stretch == upto).all() else np.flatnonzero(stretch == upto)
            held, sums = bins[:, rows], out[rows]
            for t in self.trees:
                if upto is None or t.stretch <= upto:
                    sums += np.take(t.values, t.leaf(held))
            out[rows] = sums
        return out


def begin(rows: DataFrame, columns: list[str], label: str, bins: int = 32, **settings: float) -> Model:
    """A model without trees: its bins' edges are quantiles of the rows, its odds theirs; at most 255 bins."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(F.avg(label).alias("mean"), *[F.percentile_approx(c, shares, 1000).alias(f"q{k}") for k, c in enumerate(columns)]).first()
    mean = min(max(found["mean"], 0.01), 0.99)
    return Model(columns, [np.unique(found[f"q{k}"]) for k in range(len(columns))], float(np.log(mean / (1 - mean))), **settings)


def binned(model: Model, rows: DataFrame) -> DataFrame:
    """rows with their bins as bytes in place of the model's columns."""
    kept = [f for f in rows.schema.fields if f.name not in model.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_of = model.bins(batch).T.tobytes()
            width = len(model.columns)
            cells = pa.array([bytes_of[at : at + width] for at in range(0, len(bytes_of), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), cells], names=[*(f.name for f in kept), BINS])

    return rows.mapInArrow(run, StructType([*kept, StructField(BINS, BinaryType())]))


def _level_sums(rows: DataFrame, label: str, model: Model, tree: Tree) -> np.ndarray:
    """(node, feature, bin, 3): sums of gradient, curvature and count over the rows, by the nodes of the growing tree's lowest level."""
    nodes, width = len(tree.features) + 1, max(map(len, model.edges)) + 1
    shape = (nodes, len(model.columns), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, *shape))
        for batch in batches:
            if batch.num_rows:
                bins, y = model.bins(batch), batch[label].to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-model.margins(bins)))
                node = tree.leaf(bins).astype(np.int64) * width
                for f, column in enumerate(bins):
                    slots = node + column
                    for k, v in enumerate((p - y, p * (1 - p), None)):
                        total[k, :, f] += np.bincount(slots, v, minlength=nodes * width).reshape(nodes, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = rows.select(*([BINS] if BINS in rows.columns else model.columns), label).coalesce(TASKS).mapInArrow(run, "sums binary")
    return sum(np.frombuffer(r.sums).reshape(3, *shape) for r in sums.collect()).transpose(1, 2, 3, 0)  # a row for each task: nodes * features * bins


def splits(sums: np.ndarray, least: int, weight: int = 1, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Each node's best feature and cut; a cut beyond all bins where no split gains. Gradients are weighed by curvature (1) or count (2)."""
    upto = np.cumsum(sums, 2)
    left, right = upto, upto[:, :, -1:] - upto
    worth = lambda s: s[..., 0] ** 2 / (s[..., weight] + ridge)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), worth(left) + worth(right) - worth(upto[:, :, -1:]), 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    feature, cut = np.divmod(best, gain.shape[2])
    return np.where(flat.max(1) > 1e-9, feature, 0), np.where(flat.max(1) > 1e-9, cut, gain.shape[2])


def continued(model: Model, rows: DataFrame, label: str, stretch: int, rounds: int = 1) -> Model:
    """The model with so many more trees, fitted to the rows; rows is read once for each level of a tree."""
    for _ in range(rounds):
        tree = Tree(stretch, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for _ in range(model.depth):
            sums = _level_sums(rows, label, model, tree)
            features, cuts = splits(sums, model.least)
            tree = replace(tree, features=np.append(tree.features, features), cuts=np.append(tree.cuts, cuts))
        at = np.arange(len(features))
        left = np.stack([np.cumsum(sums[k, f], 0)[min(c, sums.shape[2] - 1)] for k, f, c in zip(at, features, cuts, strict=True)])
        leaves = np.stack([left, sums[:, 0].sum(1) - left], 1).reshape(-1, 3)
        tree = replace(tree, values=-model.step * leaves[:, 0] / (leaves[:, 1] + RIDGE))
        model = replace(model, trees=[*model.trees, tree])
    return model


def scored(model: Model, rows: DataFrame, stretch: str, name: str = "prob") -> DataFrame:
    """rows (their columns or bins) with the probability by the model as of each row's stretch."""
    at = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = model.margins(model.bins(batch), batch[stretch].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-margins)))], names=[*at, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))
