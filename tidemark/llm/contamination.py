"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets.

A test item is found in a document if at least ``CONTAINMENT`` of its distinct
5-word shingles are shingles of the document. Items are partitioned by size, a
power of two a class. For a class of at most u shingles a document is read as
overlapping blocks of 2u shingles, u apart, so that item and block have similar
sizes however long the document is: a passage holding three quarters of an item
has a Jaccard similarity of 0.17 or more with some block. An item is a
candidate if any of 64 min-hash values of a block is its own; a true one is
missed with probability (1 - 0.17) ** 64 < 1e-5. Candidates are then counted
exactly on the document's whole shingle set.

Items go to the tasks in blocks of about ``BLOCK_WORDS`` words, one pass over the
documents for each block. If there are several, each pass is a job of its own
whose rows are written and whose index is given back before the next one's is
sent: executors hold one block at a time, however many items there are.
Documents are never shuffled.

Defined cases: null or blank texts have no shingles, find nothing and are
never found; a text of fewer than five words is one shingle; repeated rows and
items each report; an empty table on either side finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words as word_list
from .common import written
from .shingles import mix, shingle_sets, shingles, texts, words

SHINGLE = 5
CONTAINMENT = 0.75
HASHES = 64
BLOCK_WORDS = 2_000_000

_U32 = np.uint32
_draw = np.random.default_rng(7)
_FLIP = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL1, _MUL2 = (_draw.integers(0, 1 << 31, (2, HASHES), dtype=np.uint32) * _U32(2)) + _U32(1)


def _hashed(short: np.ndarray, k: int) -> np.ndarray:
    h = (short ^ _FLIP[k]) * _MUL1[k]
    h ^= h >> _U32(15)
    h *= _MUL2[k]
    return h


def _short(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


class ItemIndex:
    """Items of one block: their shingle sets, and min-hash values by size class."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sets = ids, sets
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                classes.setdefault((1 << len(s).bit_length()) - 1, []).append(i)
        self.classes = []
        for most, members in sorted(classes.items()):
            mins = np.array([[_hashed(_short(sets[i]), k).min() for i in members] for k in range(HASHES)], np.uint32)
            maybe = np.zeros((HASHES, 1 << 16), bool)
            for k in range(HASHES):
                maybe[k, mins[k] & _U32(0xFFFF)] = True
            order = np.argsort(mins, axis=1)
            self.classes.append((most, np.array(members), np.take_along_axis(mins, order, 1), order, maybe))

    def search(self, values: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) candidates; values: shingles of all texts in place order, texts begin at starts."""
        found: set[tuple[int, int]] = set()
        ends = np.append(starts[1:], len(values))
        short = _short(values)
        cuts = []
        for most, *_ in self.classes:  # a cell is u shingles of one text; a block is a cell and the next of the same text
            cells = -(-(ends - starts) // most)
            owner = np.repeat(np.arange(len(starts)), cells)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
            cuts.append((owner, starts[owner] + within * most))
        for k in range(HASHES):
            h = _hashed(short, k)
            for (_, members, mins, order, maybe), (owner, at) in zip(self.classes, cuts, strict=True):
                # a block's least value is that of one of its two cells: asking every cell finds all that blocks would
                low = np.minimum.reduceat(h, at)
                some = np.flatnonzero(maybe[k, low & _U32(0xFFFF)])
                first, last = np.searchsorted(mins[k], low[some], "left"), np.searchsorted(mins[k], low[some], "right")
                for j, a, b in zip(some[first < last], first[first < last], last[first < last], strict=True):
                    found.update((int(owner[j]), int(members[m])) for m in order[k, a:b])
        return found


def _batch_hits(column: pa.Array, index: ItemIndex, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item id, item's shingles, of them found)."""
    for at, data, offsets in texts(column):
        values, bounds = words(data, offsets)
        rows = np.flatnonzero(bounds[1:] > bounds[:-1])
        if not len(rows):
            continue
        runs = [shingles(values[bounds[k] : bounds[k + 1]], SHINGLE) for k in rows]
        sizes = np.array([len(r) for r in runs])
        flat = np.concatenate(runs)
        for k, i in sorted(index.search(flat, np.cumsum(sizes) - sizes)):
            common = int(np.isin(index.sets[i], runs[k]).sum())
            if common >= least * len(index.sets[i]):
                yield at + int(rows[k]), index.ids[i], len(index.sets[i]), common


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[ItemIndex, bool]]:
    """Indexes of the items, block by block, and whether there are several; a block's texts pass through the driver, no more at once. Equal items are dealt by their ids."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.size(word_list(F.col("text"))))).first()[0] or 0
    blocks = -(-total // block_words)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        yield ItemIndex(part["item_id"].to_pylist(), [s for _, s in shingle_sets(part["text"], SHINGLE)]), blocks > 1


def _settled(rows: DataFrame, sent: Broadcast, name: str) -> DataFrame:
    """rows, written, after which no executor needs what was sent."""
    out = written(rows, name)
    sent.unpersist()
    return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every item found in a document."""
    schema = "doc_id long, item_id long, n_shingles long, n_found long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, several in item_blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def hits(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_batch_hits(batch["text"], sent.value, least))
                rows, *rest = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], names=["doc_id", "item_id", "n_shingles", "n_found"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hits, schema)
        out = out.union(_settled(found, sent, "item-pairs") if several else found)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in which no item is found, all columns as they are."""
    for index, several in item_blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in _batch_hits(batch.column(at), sent.value, least)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        docs = _settled(docs, sent, "free-of-items") if several else docs
    return docs
