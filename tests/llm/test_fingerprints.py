"""Fingerprints against plain Python, and the estimates of their sketches."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as S

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"word{k * k % 9973}" for k in range(60_000))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()[:12]


def sketch(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    every = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    return sorted(h for h in map(md5, every) if int(h, 16) < 2**45), "=" + md5(" ".join(w))


def expected(rows):
    """rows in their defined order, which callers give."""
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        sets = [sketch(t) for t in (text, edited, after)]
        names = [",".join(s) or n for s, n in sets]
        alike = lambda j: 1.0 if names[0] == names[j] else len({*sets[0][0]} & {*sets[j][0]}) / max(1, len({*sets[0][0]} | {*sets[j][0]}))  # noqa: E731, B023
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), names[0], names[1], alike(1), alike(2)


@pytest.mark.parametrize("partitions", [1, 4])
def test_odd_texts(spark, partitions):
    texts = ["A b c d e f g", None, "", " \n\t", "one two", "a b c d e f g", LONG, LONG + " end", "é ß 漢字 \x00 x", *(" ".join(f"t{k}x{i}" for i in range(40)) for k in range(60))]
    rows = [(k * k * 10**9 - 5, t) for k, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows[::-1], SCHEMA).withColumns({c: F.lit("x") for c in ("hashes", "range", "at", "tie", "copy", "n_chars", "next_text")})
        assert sorted(map(tuple, S.edited_fingerprints(df).collect())) == sorted(expected(rows))
        assert S.edited_fingerprints(df.limit(0)).count() == 0
        assert [tuple(r) for r in S.edited_fingerprints(df.filter("doc_id = -5")).collect()] == list(expected(rows[:1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_and_ties(spark):
    """Every row has one next: nulls come last, and the last row's next is the first."""
    rows = [(None, f"n{k}") for k in range(50)] + [(3, "b"), (3, "a"), (3, "a"), (1, "first"), (9, None)]
    got = S.with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got) == sorted(t or "" for _, t in rows)
    assert next(r.next_text for r in got if r.doc_id == 9)[0] == "n" and next(r.next_text for r in got if r.doc_id == 1) in "ab"
    assert sum(r.next_text == "first" and r.doc_id is None for r in got) == 1
    assert sum(r.doc_id == 3 and r.next_text in ("a", "b") for r in got) == 2 and sum(r.doc_id == 3 and r.next_text == "" for r in got) == 1


def test_estimates(spark):
    """A merged sketch is that of both texts; containment is found however unequal the texts are."""
    words = LONG.split()[:5000]
    short, long = " ".join(words[1000:1400]), " ".join(words)
    other = " ".join(f"o{k}" for k in range(800))
    df = spark.createDataFrame([(1, "g", short, long), (2, "g", other, long)], "id long, host string, a string, b string").withColumns({"x": S.sketch(F.col("a")), "y": S.sketch(F.col("b"))})
    one, two = df.select("*", S.containment(F.col("x"), F.col("y")).alias("c"), S.containment(F.col("y"), F.col("x")).alias("r"), S.likeness(F.col("x"), F.col("y")).alias("l"), S.merge(F.col("x"), F.col("y")).alias("m")).orderBy("id").collect()
    assert one.c == 1 and one.r == pytest.approx(396 / 4996, abs=0.03) and one.l == one.r and two.c == two.r == 0
    assert one.m == one.y and two.m == sorted({*two.x, *two.y})
    assert len(one.y) == pytest.approx(4996 / 8, rel=0.15)
    merged = S.group_sketches(df, "host", "x")
    found = S.group_containment(merged, "host", F.array(*map(F.lit, one.x))).head()
    assert (found.n_hashes, found.n_found, found.containment) == (len({*one.x, *two.x}), len(one.x), 1)
