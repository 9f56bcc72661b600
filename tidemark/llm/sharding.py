"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Rows get gapless numbers in a stated order; a Feistel network over the smallest
near-square grid a x b that holds them, with cycle walking for the fewer than a
cells beyond, permutes the numbers. Position p goes to shard ``p % n`` at slot
``p // n``: shard counts differ by one at most, slots are gapless, and both can
be computed from the row number alone, or back from (shard, slot).

Defined cases: null keys sort first; equal rows may take each other's places; an
empty table gives an empty one; other columns pass through (the operator's own
names raise).
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_numbers

#: Fixed value: the prime modulus of the round function; its square fits a long.
PRIME = (1 << 31) - 1
ROUNDS = 6


class Feistel:
    """A permutation of 0..n-1 that depends on the seed only."""

    def __init__(self, n: int, seed: str = "shuffle") -> None:
        if n > PRIME * PRIME:
            raise ValueError("too many rows")
        self.n = n
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        digests = (hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(ROUNDS))
        self.keys = [int.from_bytes(d[:4], "big") % PRIME for d in digests]
        self.walks = max((self._walk(y) for y in range(n, self.a * self.b)), default=0)

    def _once(self, x: int) -> int:
        left, right, m, o = x // self.b, x % self.b, self.a, self.b
        for k in self.keys:
            y = (right + k) % PRIME
            left, right, m, o = right, (left + y * y % PRIME * y % PRIME) % m, o, m
        return left * self.b + right

    def _walk(self, y: int) -> int:
        """Steps from a cell beyond n back into 0..n-1."""
        steps = 0
        while y >= self.n:
            y, steps = self._once(y), steps + 1
            if steps > self.a:  # cells beyond n that only lead to each other are never entered from within
                return 0
        return steps

    def __call__(self, x: int) -> int:
        y = self._once(x)
        while y >= self.n:
            y = self._once(y)
        return y

    def _column_once(self, x: Column) -> Column:
        b = F.lit(self.b).cast("long")
        start = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
        rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(self.b if i % 2 else self.a).cast("long").alias("m")) for i, k in enumerate(self.keys)])

        def turn(s: Column, k: Column) -> Column:
            y = (s["r"] + k["k"]) % PRIME
            return F.struct(s["r"].alias("l"), ((s["l"] + y * y % PRIME * y % PRIME) % k["m"]).alias("r"))

        return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])

    def column(self, x: Column) -> Column:
        """The permutation as an expression: as many further steps as the longest walk of this n and seed has."""
        y = self._column_once(x)
        if not self.walks:
            return y
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), y, lambda v, _: F.when(v >= self.n, self._column_once(v)).otherwise(v))


def shard(df: DataFrame, n_shards: int, order: list[str], seed: str = "shuffle") -> DataFrame:
    """df with row_number, shard (int) and slot (long)."""
    taken = {"row_number", "shard", "slot"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    numbered = row_numbers(df, order)
    p = Feistel(numbered.count(), seed).column(F.col("row_number"))
    placed = numbered.select(F.struct("*").alias("row"), p.alias("p"))
    return placed.select("row.*", (F.col("p") % n_shards).cast("int").alias("shard"), F.expr(f"p div {int(n_shards)}").cast("long").alias("slot"))


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8) and text_crc32; a null text has no bytes."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
