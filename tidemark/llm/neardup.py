"""Near-duplicates by min-max hashing, confirmed on whole shingle sets.

Under each of 64 permutations a document keeps the least and the greatest value
of its shingles, so 64 hash evaluations give 128 signature values; 32 bands take
both values of two permutations each. At a similarity of 0.75 a band agrees with
probability 0.75**4, and no band does with probability 5e-6.

1. Documents with equal shingle sets are one class; only classes go on.
2. Classes that share a band form a bucket. Its most shared member is the pivot;
   buckets of one pivot are one group, dealt to blocks of at most ``MEMBERS``
   members and ``SHINGLES`` shingles, each with a copy of the pivot's set.
3. A task settles a block: members are compared with the pivot on whole sets, and
   a pair x, y of which x isn't linked to the pivot is looked at if the shingles
   that both hold beyond the pivot, with the most they can share within it, reach
   the threshold. Only links that join two components leave the task.
4. Only a group of several blocks needs more: pairs in different blocks. Two such
   members are linked only if they share a shingle beyond the pivot, which a
   prefix filter (rarest first) finds, or if what each shares with the pivot
   suffices, which a prefix filter over whole sets finds. Members that share such
   a shingle are the next round's buckets, each within its group and without the
   pivot, until no bucket spans two components. No candidate goes unchecked.

Defined cases: null or blank text has no shingles and links with nothing; rows
with the same doc_id are one node with the links of all their texts; a null
doc_id is never linked (its own component is null, and it is kept); repeated rows
get equal results; other columns are not looked at; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .components import connected_components
from .shingles import mix, shingles, texts, words

SHINGLE = 5
SIMILAR_PERCENT = 75
#: Bounds of what a task settles at once.
MEMBERS, SHINGLES = 4096, 1 << 21
PERMUTATIONS = 64
BANDS = 32

_U32 = np.uint32
_draw = np.random.default_rng(20240229)
_FLIP = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_MUL1, _MUL2 = (_draw.integers(0, 1 << 31, (2, PERMUTATIONS), dtype=np.uint32) * _U32(2)) + _U32(1)


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys from the shingles of texts that begin at starts; every text has one at least."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    signature = np.empty((2 * PERMUTATIONS, len(starts)), np.uint64)
    for k in range(PERMUTATIONS):
        h = (short ^ _FLIP[k]) * _MUL1[k]
        h ^= h >> _U32(15)
        h *= _MUL2[k]
        signature[2 * k] = np.minimum.reduceat(h, starts)
        signature[2 * k + 1] = np.maximum.reduceat(h, starts)
    width = 2 * PERMUTATIONS // BANDS
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64))[:, None], (BANDS, len(starts))).copy()
    for j in range(width):
        keys = mix(keys ^ signature[j::width])
    return keys.T


_SALTS = (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x0123456789ABCDEF))


def _filled_sets(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their shingles one after the other, sizes, (2, rows) fingerprints) for chunks of the texts that have any."""
    for at, data, offsets in texts(column):
        values, bounds = words(data, offsets)
        rows, sets = [], []
        for k in range(len(offsets) - 1):
            if bounds[k] < bounds[k + 1]:
                sets.append(np.unique(shingles(values[bounds[k] : bounds[k + 1]], SHINGLE)))
                rows.append(at + k)
        if rows:
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            starts = np.cumsum(sizes) - sizes
            yield rows, flat, sizes, np.array([np.add.reduceat(mix(flat ^ salt), starts) for salt in _SALTS])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        counts, prints, keys = np.zeros(n, np.int64), np.zeros((2, n), np.uint64), [None] * n
        for rows, flat, sizes, found in _filled_sets(batch["text"]):
            counts[rows], prints[:, rows] = sizes, found
            for row, key in zip(rows, band_keys(flat, np.cumsum(sizes) - sizes).view(np.int64), strict=True):
                keys[row] = key
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "f1", "f2", "bands"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (together the set's fingerprint), bands (null without shingles)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, flat, sizes, prints in _filled_sets(batch["text"]):
            sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sizes), *[pa.array(p.view(np.int64)) for p in prints], sets], names=["n_shingles", "f1", "f2", "set"])


def _class_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(class, set) of the members: the shingles of the texts that have the class's fingerprint."""
    wanted = classes.join(members.select("class").distinct(), "class").select("class", "rep", "n_shingles", "f1", "f2")
    held = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep").distinct(), "rep")
    sets = held.select("text").mapInArrow(_shingle_sets, "n_shingles long, f1 long, f2 long, set array<long>")
    return sets.join(wanted.drop("rep"), ["n_shingles", "f1", "f2"]).groupBy("class").agg(F.first("set").alias("set"))


_SETTLED = "u long, v long, g long, x long, n long, common long, linked boolean, rest array<long>"


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _settle(table: pa.Table) -> pa.Table:
    """Links (u, v) that join components of a block; with blocks > 1 also each member's standing to the pivot."""
    table = table.combine_chunks()
    x, component = table["x"].to_numpy(), table["component"].to_numpy()
    lists = table["set"].combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    n, m, pivot = np.diff(ends), len(x), int(np.flatnonzero(x == table["p"][0].as_py())[0])
    owner = np.repeat(np.arange(m), n)
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    at = np.minimum(np.searchsorted(sets[pivot], flat), n[pivot] - 1)
    within = sets[pivot][at] == flat
    common = np.bincount(owner[within], minlength=m)
    linked = 7 * common >= 3 * (n + n[pivot])
    _, root = np.unique(component, return_inverse=True)
    links: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            links.append((int(x[i]), int(x[j])))

    for i in np.flatnonzero(linked).tolist():
        join(pivot, i)
    beyond, holder = flat[~within], owner[~within]
    _, kind, often = np.unique(beyond, return_inverse=True, return_counts=True)
    kind, holder = kind[often[kind] > 1], holder[often[kind] > 1]
    order = np.argsort(kind, kind="stable")
    holders, first = holder[order], np.append(0, np.cumsum(np.bincount(kind, minlength=len(often))))
    mine = np.append(0, np.cumsum(np.bincount(holder, minlength=m)))
    for i in np.flatnonzero(~linked).tolist():
        kinds = kind[mine[i] : mine[i + 1]]
        met = np.concatenate([holders[first[k] : first[k + 1]] for k in kinds]) if len(kinds) else np.empty(0, np.int64)
        needed = -(-3 * (n + n[i]) // 7) - np.minimum(common, common[i])
        for j in np.flatnonzero((np.bincount(met, minlength=m) >= needed) & (root != root[i])).tolist():
            if root[i] != root[j] and 7 * _shared(sets[i], sets[j]) >= 3 * (n[i] + n[j]):
                join(i, j)
    rows = [(u, v, None, None, None, None, None, None) for u, v in links]
    if table["blocks"][0].as_py() > 1:
        g = table["g"][0].as_py()
        rows += [(None, None, g, int(x[i]), int(n[i]), int(common[i]), bool(linked[i]), sets[i][~within[ends[i] : ends[i + 1]]].view(np.int64).tolist()) for i in range(m) if i != pivot]
    types = [pa.int64()] * 6 + [pa.bool_(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SETTLED.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _open_buckets(members: DataFrame) -> DataFrame:
    """The buckets (key, ...) whose members are in two components or more."""
    spans = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    return members.join(spans.select("key"), "key")


def _blocks(members: DataFrame, by_pivot: bool) -> DataFrame:
    """(g, salt, blocks, p, x, component): buckets' members (key, class, n, component) dealt to blocks, the pivot p in each."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    weights = members.join(sizes, "key").groupBy("class").agg(F.sum("size").alias("weight"))
    pivots = members.join(weights, "class").groupBy("key").agg(F.max_by("class", F.struct("weight", "class")).alias("p"))
    group = F.col("p" if by_pivot else "key").alias("g")
    pairs = written(members.join(pivots, "key").select(group, "p", F.col("class").alias("x"), "n", "component").distinct(), "groups")
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES)).cast("long")
    dealt = pairs.join(pairs.groupBy("g").agg(blocks.alias("blocks")), "g")
    own = F.array(F.pmod(F.xxhash64("x"), F.col("blocks")))
    return dealt.withColumn("salt", F.explode(F.when(F.col("p") == F.col("x"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own))).drop("n")


def _prefixes(single: DataFrame, kept: str) -> DataFrame:
    """(key, class, n, component) from single (g, x, s, n, component and what kept needs): each member's rarest shared shingles.

    Those that one member holds alone come first in the order and reveal nothing; of
    all m others the expression ``kept`` says how many are left out at the end.
    """
    often = single.groupBy("g", "s").agg(F.count("*").alias("f")).filter("f > 1")
    member = Window.partitionBy("g", "x")
    ranked = single.join(often, ["g", "s"]).withColumn("r", F.row_number().over(member.orderBy("f", "s"))).withColumn("m", F.count("*").over(member))
    return ranked.filter(f"r <= m - ({kept})").select(F.xxhash64("g", "s").alias("key"), F.col("x").alias("class"), "n", "component")


def _across_blocks(wide: DataFrame, sets: DataFrame) -> DataFrame:
    """Buckets of the members (g, x, n, common, linked, rest, component) of groups with several blocks.

    x and y are linked only if they share 3/7 (n_x + n_y) shingles or more. By the pivot, at
    most the lesser ``common`` of them lie within it. Where that is too few, the last ones of
    x's shingles beyond the pivot may be left out of x's prefix. Otherwise both are close to
    subsets of the pivot, y smaller than it, and a prefix of their whole sets reveals them.
    """
    sizes = wide.groupBy("g").agg(F.min("n").alias("least"))
    rows = wide.join(sizes, "g")
    low = "greatest(ceil(n * 3 / 4), least)"
    beyond = rows.select("g", "x", "n", "common", "component", "least", F.explode("rest").alias("s"))
    buckets = _prefixes(beyond, f"greatest(1, ceil((n + {low}) * 3 / 7) - common) - 1")
    reach = rows.filter("not linked").groupBy("g").agg(F.max(F.floor((F.col("common") * 7 - F.col("n") * 3) / 3)).alias("most"))
    tight = rows.join(reach, "g").filter(f"(not linked and 7 * common >= 3 * (n + {low})) or (n <= most and 7 * common >= 3 * (n + {low}))")
    whole = tight.join(sets.withColumnRenamed("class", "x"), "x").select("g", "x", "n", "component", F.explode("set").alias("s"))
    return buckets.union(_prefixes(whole.withColumn("g", F.xxhash64(F.lit("whole"), "g")), "ceil(n * 3 / 4) - 1"))


def linked_classes(classes: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) over classes (class, rep, n_shingles, f1, f2, bands), given links (u, v) between them."""
    placed = classes.select("class", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"), F.col("class").alias("component"))
    members = written(_open_buckets(placed), "bucket-members")
    sets = written(_class_sets(docs, classes, members), "class-sets")
    by_pivot = True
    while True:
        rows = _blocks(members, by_pivot).join(sets.withColumnRenamed("class", "x"), "x")
        settled = written(rows.groupBy("g", "salt").applyInArrow(_settle, _SETTLED), "settled")
        components = connected_components(links.union(settled.filter("u is not null").select("u", "v")))
        wide = settled.filter("x is not null").drop("u", "v")
        if wide.isEmpty():
            return components
        named = wide.join(components.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        members = written(_open_buckets(_across_blocks(_open_buckets(named.withColumn("key", F.col("g"))).drop("key"), sets)), "bucket-members")
        links, by_pivot = components.toDF("u", "v"), False
        if members.isEmpty():
            return components


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every row of docs (doc_id, text)."""
    signed = written(signatures(docs), "signatures")
    print_ = ["n_shingles", "f1", "f2"]
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy(*print_).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    known = classes.select(*print_, "class", "rep")
    # rows of one doc_id with different texts: their classes are linked
    texts_of = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*print_)).alias("a"), F.max(F.struct(*print_)).alias("b"))
    again = written(signed.join(texts_of.filter("a < b").select("doc_id"), "doc_id").join(known, print_, "left").select("doc_id", "class"), "repeated-ids")
    same = again.filter("class is not null").groupBy("doc_id").agg(F.min("class").alias("v")).join(again, "doc_id").select(F.col("class").alias("u"), "v")
    components = written(linked_classes(classes, docs, same), "components")
    roots = components.select(F.col("component").alias("node"), "component").distinct()
    placed = components.union(roots).join(known.select(F.col("class").alias("node"), "rep"), "node")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    named = known.join(placed.join(least, "component").select(F.col("node").alias("class"), "least"), "class", "left")
    out = signed.drop("bands").join(named.select(*print_, F.coalesce("least", "rep").alias("_least")), print_, "left")
    if not again.isEmpty():  # a row without shingles follows the other rows of its doc_id
        by_id = out.join(again.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min("_least").alias("_by_id"))
        out = out.join(by_id, "doc_id", "left").withColumn("_least", F.coalesce("_least", "_by_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
