"""Alignment of two tokenizers' tokens over the same bytes, with Arrow tables inside Spark tasks.

A is a byte-level BPE file that sees space + text, B a sentencepiece model that
adds the space itself. Where tokens of both end at one byte, a group ends; two
tokens are linked if their byte ranges overlap.

Neither tokenizer's tokens cross from a character that is not white space to a
space: A's split ends there, and no piece of B has the space mark after another
character (checked when the model is loaded). So a text falls into units, each
a space and what follows, which are encoded apart. A task deals its rows to
blocks of ``BLOCK_BYTES`` of text and encodes a block's distinct units once, as
an Arrow pipeline: the lists of ids are flattened with their parent indices,
byte lengths become ends by segmented cumulative sums, a full outer hash join
of both sides' (unit, end) keys gives the segments between ends, each of which
is one link, and Table.group_by counts the block's pairs.

Spark adds the blocks' counts for each pair, finds each B id's highest count
and deals the counts of a block's pairs back to the block, where units and then
documents add them up. A block is the largest thing that a task gathers; a text
longer than ``BLOCK_BYTES`` is a block of its own. The only broadcast has a row
for each entry of B's vocabulary at most.

Defined cases: null or empty texts, and texts whose tokens' bytes are not those
of space + text (B reads U+2581 as a space), have zeros, '' as digest, and count
nowhere; equal rows repeat and count each; an empty table gives an empty one;
other columns than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import _byte_symbols

FILE_A = "byte_bpe_50k.json"
FILE_B = "piece_bpe_32k.model"
BLOCK_BYTES = 16 << 20
UNITS_AT_ONCE = 1 << 13
LISTED = 8192  # entries of a block's tables that one row carries
#: A unit ends where a space follows another character and is not the text's last.
UNIT_END = re.compile(r"(?<=\S) (?=.)", re.S)
SPACE_MARK = "▁"

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK_ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units array<int>, first int, pairs array<long>, pair_counts array<long>, unit_links array<array<int>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_loaded: dict[tuple[str, str], Tokenizers] = {}


class Tokenizers:
    """Both tokenizers of a worker with the bytes of their entries."""

    def __init__(self, file_a: str, file_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.size_a = max(entries) + 1
        self.bytes_a = pa.array([bytes(byte_of[c] for c in entries.get(i, "")) for i in range(self.size_a)], pa.large_binary())
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("the model has pieces over word borders")
        self.size_b = len(pieces)
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        marked = [f"{i}{mark}" for size, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(size)]
        #: An id and what follows it in a digest: A's before ',' and '|', then B's before ',' and ';'.
        self.marked = pa.array(marked, pa.large_string())

    def encode(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        return pa.array(a, pa.list_(pa.int32())), pa.array(self.b.encode(units, num_threads=1), pa.list_(pa.int32()))


def tokenizers(file_a: str, file_b: str) -> Tokenizers:
    if (file_a, file_b) not in _loaded:
        _loaded[file_a, file_b] = Tokenizers(file_a, file_b)
    return _loaded[file_a, file_b]


def _joined(lists: pa.ListArray, entries: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """For each list of ids the bytes of its entries, one after the other."""
    flat = entries.take(pc.list_flatten(lists))
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    offsets = ends[_bounds(lists)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(offsets)), flat.buffers()[2]])


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened values, and their count."""
    out = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=out[1:])
    return out


def _ends(lists: pa.ListArray, entries: pa.LargeBinaryArray) -> pa.Table:
    """unit, end (byte within its unit, one past the token) and place of every token."""
    flat, unit = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(entries).take(flat), pa.int64()))
    before = np.concatenate([[0], total.to_numpy()])[_bounds(lists)[:-1]]
    return pa.table({"unit": unit, "end": pc.subtract(total, pa.array(before).take(unit)), "place": pa.array(np.arange(len(flat)))})


class Aligned:
    """Units with their counts, their links' pair codes (a * size of B + b) in order, and their groups as text, each group closed by ';'."""

    def __init__(self, t: Tokenizers, units: list[str]) -> None:
        every_a, every_b = t.encode(units)
        wanted = pa.array([b" " + u.encode() for u in units], pa.large_binary())
        self.valid = pc.and_(pc.equal(_joined(every_a, t.bytes_a), wanted), pc.equal(_joined(every_b, t.bytes_b), wanted)).to_numpy(zero_copy_only=False)
        nothing = pa.scalar([], pa.list_(pa.int32()))
        mask = pa.array(self.valid)
        lists_a, lists_b = pc.if_else(mask, every_a, nothing), pc.if_else(mask, every_b, nothing)
        flat_a, flat_b = pc.list_flatten(lists_a), pc.list_flatten(lists_b)
        segments = _ends(lists_a, t.bytes_a).join(_ends(lists_b, t.bytes_b), ["unit", "end"], join_type="full outer", left_suffix="_a", right_suffix="_b", use_threads=False).combine_chunks().sort_by([("unit", "ascending"), ("end", "ascending")])
        at_a, at_b = segments["place_a"].combine_chunks(), segments["place_b"].combine_chunks()
        both = pc.and_(pc.is_valid(at_a), pc.is_valid(at_b))
        closing_a, closing_b = at_a.filter(both).to_numpy(), at_b.filter(both).to_numpy()
        # a segment belongs to the tokens that end with it or next after it
        a, b = (flat.take(pc.fill_null_backward(at)) for flat, at in ((flat_a, at_a), (flat_b, at_b)))
        self.pairs = pc.add(pc.multiply(pc.cast(a, pa.int64()), t.size_b), pc.cast(b, pa.int64()))
        unit = segments["unit"].to_numpy()
        self.n_a, self.n_b = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists_a, lists_b))
        self.n_links = np.bincount(unit, minlength=len(units))
        self.n_groups = np.bincount(unit[both.to_numpy(zero_copy_only=False)], minlength=len(units))
        self.text = self._groups(t, flat_a.to_numpy(), flat_b.to_numpy(), closing_a, closing_b)

    def _groups(self, t: Tokenizers, a: np.ndarray, b: np.ndarray, closing_a: np.ndarray, closing_b: np.ndarray) -> pa.LargeStringArray:
        """Tokens in group order: a group's A ids stand after the groups before it, its B ids after its A ids."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[closing_a], last_b[closing_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], closing_b + 1])[group_a]] = a + t.size_a * last_a
        order[np.arange(len(b)) + (closing_a + 1)[group_b]] = 2 * t.size_a + b + t.size_b * last_b
        flat = t.marked.take(pa.array(order))
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
        offsets = ends[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), flat.buffers()[2])


class Block:
    """Rows of a task until they hold BLOCK_BYTES of text."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.ids: list[int | None] = []
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.units: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        parts = UNIT_END.split(text) if text else []
        self.ids.append(doc_id)
        self.units.append(np.fromiter(map(self.known.__getitem__, parts), np.int32, len(parts)))
        self.size += len(text or "")

    def rows(self, t: Tokenizers) -> Iterator[pa.RecordBatch]:
        names = list(self.known)
        parts = [Aligned(t, names[k : k + UNITS_AT_ONCE]) for k in range(0, len(names), UNITS_AT_ONCE)]
        joined = lambda kind: np.concatenate([getattr(p, kind) for p in parts]) if parts else np.zeros(0, np.int64)
        counts, valid, unit_text = {c: joined(c) for c in COUNTS}, joined("valid").astype(bool), pa.chunked_array([p.text for p in parts], pa.large_string()).combine_chunks()
        met = np.zeros(len(names), np.int64)
        for k, units in enumerate(self.units):
            if not valid[units].all():
                self.units[k] = units[:0]
            np.add.at(met, self.units[k], 1)
        yield from self._documents(counts, unit_text)
        if parts:
            yield from self._tables(pa.chunked_array([p.pairs for p in parts]).combine_chunks(), counts["n_links"], met)

    def _documents(self, counts: dict[str, np.ndarray], unit_text: pa.LargeStringArray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 256):
            units = self.units[at : at + 256]
            digests = []
            for u in units:
                joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(u)], unit_text.take(pa.array(u))), pa.scalar("", pa.large_string()))
                digests.append(hashlib.sha256(memoryview(joined.buffers()[2])[: len(joined[0].as_buffer()) - 1]).hexdigest() if len(u) else "")
            sums = {c: [int(counts[c][u].sum()) for u in units] for c in COUNTS}
            yield _batch(len(units), block=[self.number] * len(units), doc_id=self.ids[at : at + 256], **sums, groups_sha256=digests, units=units)

    def _tables(self, pairs: pa.Array, n_links: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The block's distinct pairs with their counts, and each unit's links as places among them."""
        coded = pairs.dictionary_encode()
        distinct, places = coded.dictionary, coded.indices.to_numpy()
        weighted = pa.table({"place": places, "n": np.repeat(met, n_links)}).group_by("place", use_threads=False).aggregate([("n", "sum")])
        counted = np.zeros(len(distinct), np.int64)
        counted[weighted["place"].to_numpy()] = weighted["n_sum"].to_numpy()
        for at in range(0, len(distinct), LISTED):
            yield _batch(1, block=[self.number], first=[at], pairs=[distinct[at : at + LISTED]], pair_counts=[counted[at : at + LISTED]])
        ends = np.concatenate([[0], np.cumsum(n_links)])
        for at in range(0, len(met), LISTED):
            to = min(at + LISTED, len(met))
            inner = pa.ListArray.from_arrays(pa.array((ends[at : to + 1] - ends[at]).astype(np.int32)), pa.array(places[ends[at] : ends[to]].astype(np.int32)))
            yield _batch(1, block=[self.number], first=[at], unit_links=pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), inner))


_KINDS = {"block": pa.int64(), "doc_id": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "groups_sha256": pa.string(), "units": pa.list_(pa.int32()), "first": pa.int32(), "pairs": pa.list_(pa.int64()), "pair_counts": pa.list_(pa.int64()), "unit_links": pa.list_(pa.list_(pa.int32()))}


def _batch(rows: int, **columns: object) -> pa.RecordBatch:
    """Rows with these columns, and nulls in the others of BLOCK_ROWS."""
    made = [pa.nulls(rows, kind) if (v := columns.get(name)) is None else v if isinstance(v, pa.Array) else pa.array(v, kind) for name, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays(made, names=list(_KINDS))


def block_rows(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """BLOCK_ROWS: a row for each document, and the tables of each block in rows with ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(file_a, file_b), TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                block.add(doc_id.as_py(), text.as_py())
                if block.size >= BLOCK_BYTES:
                    yield from block.rows(t)
                    block = Block(block.number + 1)
        if block.ids:
            yield from block.rows(t)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK_ROWS)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair, count and best (whether no pair of its B id has a higher count), over all blocks."""
    listed = blocks.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p"))
    counted = listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("count")).filter("count > 0")
    counted = written(counted.withColumn("b", F.col("pair") % size_b), "pair-counts")
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))  # a row for each of B's entries at most
    return counted.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _totals(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links; right: place, count and best of the block's pairs."""
    docs = left.filter(pc.is_null(left["first"]))
    units = left.filter(pc.is_valid(left["first"])).sort_by("first")["unit_links"].combine_chunks()
    length = (pc.max(right["place"]).as_py() + 1) if right.num_rows else 0
    counted, best = np.zeros(length, np.int64), np.zeros(length, np.int64)
    place = right["place"].to_numpy()
    counted[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
    links = pc.list_flatten(units)
    places, bounds = pc.list_flatten(links).to_numpy(), _bounds(links)
    upto = lambda values: np.concatenate([[0], np.cumsum(values)])
    of_unit = [np.diff(upto(v[places])[bounds]) for v in (counted, best)]
    each = docs["units"].combine_chunks()
    met, ends = pc.list_flatten(each).to_numpy(), _bounds(each)
    count_sum, n_best = (np.diff(upto(v[met])[ends]) for v in of_unit)
    return pa.table([docs["doc_id"], *(docs[c] for c in COUNTS), pa.array(n_best), pa.array(count_sum), docs["groups_sha256"]], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def aligned_documents(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """RESULT for every row of docs (doc_id, text)."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=file_b).get_piece_size()
    blocks = written(block_rows(docs, file_a, file_b), "alignment-blocks")
    counts = pair_counts(blocks, size_b)
    listed = blocks.filter("pairs is not null").select("block", "first", F.posexplode("pairs").alias("at", "pair"))
    places = listed.join(counts, "pair").select(F.col("block").alias("of_block"), (F.col("first") + F.col("at")).alias("place"), "count", "best")
    own = blocks.filter("pairs is null").select("block", "doc_id", *COUNTS, "groups_sha256", "units", "first", "unit_links")
    return own.groupBy("block").cogroup(places.groupBy("of_block")).applyInArrow(_totals, RESULT)
