"""Near-duplicate classes against all pairs by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> component_id."""
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def families(seed):
    """Copies near the threshold: edited words (some edits shared), cut ends, chains of copies, a passage that unrelated texts share."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows, at = [], 0
    for size, count in ((60, 40), (120, 40), (30, 25)):
        base = [word() for _ in range(size)]
        edits = [(draw.randrange(size), word()) for _ in range(6)]
        last = base
        for k in range(count):
            w = list(last if k % 5 == 4 else base)
            for _ in range(draw.randrange(5)):
                i, x = draw.choice(edits) if draw.random() < 0.5 else (draw.randrange(len(w)), word())
                w[min(i, len(w) - 1)] = x
            if k % 3 == 0:
                w = w[draw.randrange(size // 6) : len(w) - draw.randrange(size // 5)]
            last = w
            rows.append((at, " ".join(w)))
            at += 1
    passage = [word() for _ in range(40)]
    rows += [(at + k, " ".join([*passage, *[word() for _ in range(draw.randrange(8, 40))]])) for k in range(30)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("members", "shingles"), [(4096, 1 << 21), (10, 1 << 21)])
def test_components_at_every_block_size(spark, monkeypatch, members, shingles):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "SHINGLES", shingles)
    rows = families(members)
    want = brute(rows)
    assert len(set(want.values())) < len(want) - 20
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingle_set(dict(rows)[i])) for i, r in got.items())


def test_rows_of_one_document_are_one_node(spark):
    words = lambda k: [f"t{k}x{i}" for i in range(30)]
    text = lambda k, *more: " ".join([*words(k), *more])
    rows = [(5, text("a")), (5, text("b")), (6, text("b", "more")), (7, text("a", "word")), (3, text("c")), (9, text("c")), (9, ""), (8, None), (8, text("d")), (None, text("d"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("class", "rep", "component_id", "kept", "n_shingles", "key", "set")})
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 5, True), (6, 5, False), (7, 5, False), (3, 3, True), (9, 3, False), (8, 8, True), (None, None, True)}
    assert neardup.near_duplicates(df.limit(0)).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
