"""Document fingerprints: threshold-scaled sketches of word shingles (DataFrame functions only).

A text's sketch is every hash of its five-word shingles below a fixed fraction
of the hash values, sorted and distinct. Whether a shingle is kept depends on
the shingle alone, so the sketch of many texts together is the union of their
sketches (``merge``, ``group_sketches``), and the share of a sketch that another
holds estimates containment however unequal the texts are (``containment``),
their common share the likeness of the texts' shingle sets (``likeness``).

Shingles are five lower-case words (all of them where there are fewer); a hash is
the first 48 bits of the MD5 of the words joined by spaces, written as hex.
A fingerprint joins a sketch with commas. A text of which no shingle is kept is
named by '=' and the hash of all its words: alike to an equal one only.

``with_next`` gives every row the next one's columns in doc_id order without a
window over the table: rows go to ranges of doc_id found by approximate
percentiles, and the first row of a range is copied behind the range before.

Defined cases: null text counts as empty, an empty text has the fingerprint of no
words; null doc_ids come last, in the order of their texts' hashes; equal doc_ids
are ordered by hash and text; the only row is its own next; an empty table
gives an empty one; other columns than doc_id and text are left out.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

FRACTION = 1 / 8
SHINGLE_WORDS = 5
HASH_DIGITS = 12
RANGES_PER_PARTITION = 4  # of doc_id, for each shuffle partition
NULL_RANGES = 64


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes of the text's shingles below the fraction."""
    below = F.lit(format(int(fraction * 16**HASH_DIGITS), f"0{HASH_DIGITS + 1}x")[1:] if fraction < 1 else "g")

    def hashes(w: Column) -> Column:
        every = F.transform(w, lambda _, i: _hash(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE_WORDS)])))
        whole = F.slice(every, F.lit(1), F.greatest(F.size(w) - (SHINGLE_WORDS - 1), F.lit(1)))
        return F.sort_array(F.array_distinct(F.transform(F.filter(whole, lambda h: h < below), lambda h: F.left(h, F.lit(HASH_DIGITS)))))

    return let(words(F.lower(text)), hashes)


def fingerprint(text: Column, hashes: Column) -> Column:
    """The sketch as text."""
    named = F.concat(F.lit("="), F.left(_hash(F.array_join(words(F.lower(text)), " ")), F.lit(HASH_DIGITS)))
    return F.when(F.size(hashes) > 0, F.array_join(hashes, ",")).otherwise(named)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null if a's sketch is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated common share of all shingles of two sketches; null if both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.try_divide(n, F.size(a) + F.size(b) - n))


def group_sketches(df: DataFrame, key: str, hashes: str) -> DataFrame:
    """key, hash: the sketch of each key's texts together, a row for each hash, so that no group has to fit anywhere."""
    return df.select(key, F.explode(hashes).alias("hash")).distinct()


def group_containment(sketches: DataFrame, key: str, text_hashes: Column) -> DataFrame:
    """sketches (key, hash) against one sketch: key, n_hashes, n_found and the estimated share of the text that each key's texts hold."""
    found = sketches.groupBy(key).agg(F.count("*").alias("n_hashes"), F.count_if(F.array_contains(text_hashes, F.col("hash"))).alias("n_found"))
    return found.withColumn("containment", F.try_divide(F.col("n_found"), F.size(text_hashes)))


def _numbers(values: list, kind: str) -> Column:
    """An array that the optimizer folds to one literal, however many values it has."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below value; looks at about two roots of them."""
    step = isqrt(len(bounds)) + 1
    below = lambda at: F.size(F.filter(at, lambda b: b <= value))
    coarse, fine = _numbers(bounds[::step], "bigint"), _numbers(bounds, "bigint")
    return let(F.greatest(below(coarse) - 1, F.lit(0)) * step, lambda start: start + below(F.slice(fine, start + 1, F.lit(step))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, hashes of every row, next_text and next_hashes of the next by doc_id (after the last: the first)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc_id", _numbers([k / ranges for k in range(1, ranges)], "double"), 10 * ranges)).head()[0]
    bounds = sorted(set(bounds or []))
    null_range = F.shiftrightunsigned("tie", 57).cast("int") + len(bounds) + 1
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), null_range).otherwise(_range_of(F.col("doc_id"), bounds) if bounds else F.lit(0)))
    rows = rows.withColumn("at", F.coalesce("doc_id", "tie"))
    # a row for each range, whose number is bounded
    firsts = sorted((r["range"], r["least"]) for r in rows.groupBy("range").agg(F.min("at").alias("least")).collect())
    before = spark.createDataFrame([(r, least, firsts[k - 1][0]) for k, (r, least) in enumerate(firsts)], "range int, at long, before int")
    first = rows.join(F.broadcast(before), ["range", "at"]).groupBy("before").agg(F.min_by(F.struct("doc_id", "text", "tie", "at"), F.struct("tie", "text")).alias("r"))
    copies = first.select("r.*", F.col("before").alias("range")).withColumn("copy", F.lit(True))
    dealt = rows.withColumn("copy", F.lit(False)).unionByName(copies).repartition("range").withColumn("hashes", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("copy", "at", "tie", "text")
    out = dealt.withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)})
    return out.filter("not copy").select("doc_id", "text", "hashes", "next_text", "next_hashes")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text ends with the first characters of the next document's in
    place of its last quarter.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - quarter), F.left(F.col("next_text"), quarter)))
    rows = rows.withColumn("edited_hashes", sketch(F.col("edited")))
    rows = rows.withColumns({name: fingerprint(F.col(text), F.col(hashes)) for name, text, hashes in (("fingerprint", "text", "hashes"), ("edited_fingerprint", "edited", "edited_hashes"), ("next_fingerprint", "next_text", "next_hashes"))})
    alike = lambda other: F.when(F.col("fingerprint") == F.col(f"{other}_fingerprint"), F.lit(1.0)).otherwise(F.coalesce(likeness(F.col("hashes"), F.col(f"{other}_hashes")), F.lit(0.0)))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", alike("edited").alias("near_edited"), alike("next").alias("near_next"))
