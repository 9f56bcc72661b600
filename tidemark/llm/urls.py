"""URL filters by a Bloom filter cascade (DataFrame functions only).

A list entry is (host, path): it fits a url if the url's host is that host or
one of its subdomains and the url's path starts with that path. A url's
candidate keys are its host suffixes times its path's prefixes, at the label
counts and path lengths that the list has. Level 0 of a cascade encodes the
listed keys, level 1 those of the corpus's other candidate keys that level 0
wrongly passes, level 2 the listed keys that level 1 passes, and so on until a
level passes nothing wrong. A key is listed if the first level that lacks it is
an odd one. That is exact for every key of the corpus, with no join: the levels
are literals of the expression. Their size depends on the list, since level 0's
false positive rate is set from the two counts; ``MAX_BITS`` bounds it.

Defined cases: null url or none with ``://``: empty host and path, no rule,
verdict allow. Repeated rows and other columns pass through (those named like the
operator's four own raise). An empty table gives an empty one. An empty list fits
nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The rules (host, path, verdict) of the production query and the hosts that its list blocks.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

MAX_BITS = 1 << 26
MAX_LEVELS = 64
_SEPARATOR = "\x00"


def url_parts(df: DataFrame) -> DataFrame:
    """df with host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1))
    bare = F.substring_index(rest, "?", 1)
    host = F.substring_index(bare, "/", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumn("host", F.coalesce(F.translate(host, upper, lower), F.lit(""))).withColumn("path", F.coalesce(F.substr(bare, F.length(host) + 1), F.lit("")))


def candidate_keys(entries: list[tuple[str, str]]) -> Column:
    """Array of struct(key, length): every (host suffix, path prefix) of a row that could be an entry, longest first."""
    labels = sorted({h.count(".") + 1 for h, _ in entries}, reverse=True)
    lengths = sorted({len(p) for _, p in entries}, reverse=True)
    n_labels = F.size(F.split("host", r"\."))
    cells = []
    for n in labels:
        for m in lengths:
            suffix, prefix = F.substring_index("host", ".", -n), F.substring("path", 1, m)
            fits = (n_labels >= n) & (F.length("path") >= m) & (F.col("host") != "")
            cells.append(F.when(fits, F.struct(F.concat(suffix, F.lit(_SEPARATOR), prefix).alias("key"), (F.length(suffix) + m).alias("length"))))
    if not cells:
        return F.array().cast("array<struct<key:string,length:int>>")
    return F.reverse(F.sort_array(F.transform(F.array_compact(F.array(*cells)), lambda x: F.struct(x["length"].alias("length"), x["key"].alias("key")))))


class Cascade:
    """Bit arrays by level, and the expression that asks them."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, list[int]]] = []  # bits, hashes, words

    @staticmethod
    def _bits(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits)) for k in range(hashes)]

    def _passes(self, key: Column, level: int) -> Column:
        bits, hashes, words = self.levels[level]
        table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to a literal
        return reduce(lambda a, b: a & b, [F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1 for at in self._bits(key, level, bits, hashes)])

    @staticmethod
    def shape(count: int, rate: float) -> tuple[int, int]:
        """(bits, hashes) of a level."""
        hashes = max(1, round(-math.log2(rate)))
        return max(64, 64 * math.ceil(count * hashes / math.log(2) / 64)), hashes

    def add(self, keys: DataFrame, count: int, rate: float) -> None:
        """One more level over the column key. Only the bit words come to the driver."""
        bits, hashes = self.shape(count, rate)
        at = keys.select(F.explode(F.array(*self._bits(F.col("key"), len(self.levels), bits, hashes))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b")).collect()
        table = [0] * (bits // 64)
        for w, b in words:
            table[w] = b
        self.levels.append((bits, hashes, table))

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        result = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            result = F.when(~self._passes(key, level), F.lit(level % 2 == 1)).otherwise(result)
        return result


class Cascades:
    """Cascades by the keys' hash, each within MAX_BITS a level or so."""

    def __init__(self, parts: list[Cascade]) -> None:
        self.parts = parts

    @staticmethod
    def part(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))

    def has(self, key: Column) -> Column:
        result = self.parts[0].has(key)
        for k, cascade in enumerate(self.parts[1:], 1):
            result = F.when(self.part(key, len(self.parts)) == k, cascade.has(key)).otherwise(result)
        return result


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascades:
    """listed, universe: distinct values of the column key. Exact for every key in either."""
    outside = written(universe.join(F.broadcast(listed) if _small(listed) else listed, "key", "left_anti"), "url-universe")
    n_in, n_out = listed.count(), outside.count()
    rate = min(0.5, n_in / max(1.0, math.sqrt(2) * n_out)) if n_in else 0.5
    parts = max(1, math.ceil(Cascade.shape(n_in, rate)[0] / max_bits))
    own = lambda df, k: df if parts == 1 else df.filter(Cascades.part(F.col("key"), parts) == k)
    return Cascades([_build(own(listed, k), own(outside, k), rate) for k in range(parts)])


def _build(inside: DataFrame, outside: DataFrame, rate: float) -> Cascade:
    cascade, n_in = Cascade(), inside.count()
    while n_in and len(cascade.levels) < MAX_LEVELS:
        cascade.add(inside, n_in, rate)
        passed = outside.filter(cascade._passes(F.col("key"), len(cascade.levels) - 1))
        inside, outside, rate = written(passed, "url-level"), inside, 0.5
        n_in = inside.count()
    if n_in:
        raise RuntimeError(f"keys are left after {MAX_LEVELS} levels")
    return cascade


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked_hosts: list[str] = BLOCKED_HOSTS) -> DataFrame:
    """df with host, path, rule and verdict: that of the longest rule that fits, else block for a blocked host or its subdomains, else allow.

    Both lists are held by one cascade over the corpus's candidate keys; a rule's
    verdict is a short literal map of the rules alone.
    """
    spark = df.sparkSession
    taken = {"host", "path", "rule", "verdict"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    by_rule = {f"{h}{_SEPARATOR}{p}": (f"{h}{p}", v) for h, p, v in rules}
    blocked = [f"{h}{_SEPARATOR}" for h in blocked_hosts]
    entries = [(h, p) for h, p, _ in rules] + [(h, "") for h in blocked_hosts]
    parts = url_parts(df.select(F.struct("*").alias("row"), "url")).withColumn("keys", candidate_keys(entries))
    universe = url_parts(df.select("url")).select(F.explode(F.transform(candidate_keys(entries), lambda x: x["key"])).alias("key")).distinct()
    keys = [(k,) for k in dict.fromkeys([*by_rule, *blocked])]
    listed = spark.createDataFrame(keys, "key string")
    cascade = build_cascade(listed, universe)
    found = F.transform(F.filter("keys", lambda x: cascade.has(x["key"])), lambda x: x["key"])
    out = parts.withColumn("found", found)
    rule, verdict, is_rule = F.lit(None).cast("string"), F.lit(None).cast("string"), None
    if by_rule:
        names = F.create_map(*[F.lit(x) for k, (n, _) in by_rule.items() for x in (k, n)])
        verdicts = F.create_map(*[F.lit(x) for n, v in by_rule.values() for x in (n, v)])
        is_rule = F.get(F.filter("found", lambda x: F.map_contains_key(names, x)), F.lit(0))
        rule = F.try_element_at(names, is_rule)
        verdict = F.try_element_at(verdicts, F.col("rule"))
    listed_host = F.exists("found", lambda x: x.endswith(_SEPARATOR))
    out = out.withColumn("rule", rule)
    return out.withColumn("verdict", F.coalesce(verdict, F.when(listed_host, "block").otherwise("allow"))).select("row.*", "host", "path", "rule", "verdict")
