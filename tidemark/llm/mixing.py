"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, weigh 5, 2, 1, repeating. They share
``budget`` times all words; a target stops at ``max_epochs`` times its source's
words and the excess goes to the others by weight until none is above.

Within a source every document expects the same copies, target / source words.
Documents stand in the order of their size, the prefix sum of expected copies
is moved up by one random offset a source (from its name and the seed), and a
document is emitted once for each integer that its step crosses. As sizes rise
along the order, a source's taken words differ from its target by little more
than its longest document's. No document is taken more than ``max_epochs``
times.

Defined cases: null text has size 0; a null source is a source of its own; a
source without words has target 0; equal documents may take each other's
copies; an empty table gives an empty one. ``mix`` returns df's columns beside
its own, whose names raise; ``mixed_rows`` takes any columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_numbers, words, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (key: 's' and the name, or 't' for null; source_size) with target; sums alone come to the driver."""
    ranked = row_numbers(sources, ["key"], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight), "sources")
    most = F.col("source_size") * max_epochs
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        above = most < F.col("weight") * share
        capped, free = ranked.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first()
        again = (budget * total - (capped or 0)) / free if free else share
        if again <= share:  # no further source is above
            return ranked.withColumn("target", F.when(above, most.cast("double")).otherwise(F.col("weight") * F.lit(share))).drop("rank", "weight")
        share = again


def offset(source: Column, seed: int) -> Column:
    """A fraction from 0 to 1 that the source and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat(source, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


OWN = ("size", "source_size", "target", "copies", "taken")


def _mixed(rows: DataFrame, seed: int, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """rows (row, source, doc_id, size) with source_size, target, copies and taken."""
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")))
    numbered = row_numbers(keyed, ["key", "size", "doc_id"], "n")
    sources = numbered.groupBy("key").agg(F.sum("size").alias("source_size"), F.min("n").alias("first"))
    targets = source_targets(sources, weights, budget, max_epochs)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    at = F.col("n") - F.col("first")
    crossed = F.floor(F.col("offset") + (at + 1) * F.col("rate")) - F.floor(F.col("offset") + at * F.col("rate"))
    copies = F.greatest(F.lit(0), F.least(F.lit(max_epochs), crossed)).cast("long")  # a rate of exactly max_epochs may round up
    joined = numbered.join(targets.withColumn("rate", rate).withColumn("offset", offset(F.col("key"), seed)), "key")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(df: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, sizes: str | None = None) -> DataFrame:
    """df with size, source_size, target, copies (long, the times to take it) and taken (copies * size).

    sizes: a long column that already has the sizes; otherwise the text's words are counted.
    """
    size = F.col(sizes) if sizes else F.size(words(F.col("text"))).cast("long")
    held = [c for c in df.columns if not (c == "size" and sizes == "size")]
    taken = set(OWN) & {c.lower() for c in held}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    rows = df.select(F.struct(*held).alias("row"), "source", "doc_id", size.alias("size"))
    return _mixed(rows, seed, weights, budget, max_epochs).select("row.*", *OWN)


def mixed_rows(df: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: df's columns, each row as often as it is taken."""
    rows = df.select(F.struct("*").alias("row"), "source", "doc_id", F.size(words(F.col("text"))).cast("long").alias("size"))
    plan = _mixed(rows, seed, weights, budget, max_epochs).filter("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
