"""Aligned tokens against whole-text encodings, walked token by token."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = public_tokenizers.path(alignment.FILE_A), public_tokenizers.path(alignment.FILE_B)
ODD = [None, "", " a", "a  b", "a ", "  ", "\n x", "é́ ﬁ", "　x y", "\x00a", "<s> </s> a", "a▁b c", "▁", "<0x41> <|endoftext|> don't\n\n  we 're  ", "一二三 漢字 1234567", "\x1c \x1d b", "x  y   z", "a b c d" * 3000]


def walked(t, text):
    """(links, groups) of a text, from its two whole encodings."""
    if not text:
        return [], []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    bytes_a, bytes_b = [t.bytes_a[i].as_py() for i in a], [t.bytes_b[i].as_py() for i in b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    links, groups, i, j, end_a, end_b = [], [([], [])], 0, 0, len(bytes_a[0]), len(bytes_b[0])
    groups[0][0].append(a[0])
    groups[0][1].append(b[0])
    while True:
        links.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            if i + 1 == len(a):
                return links, groups
            groups.append(([], []))
        if step_a:
            i += 1
            end_a += len(bytes_a[i])
            groups[-1][0].append(a[i])
        if step_b:
            j += 1
            end_b += len(bytes_b[j])
            groups[-1][1].append(b[j])


def expected(t, texts):
    found = [walked(t, x) for x in texts]
    counts = Counter(p for links, _ in found for p in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for links, groups in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def of(row):
    return row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256


def test_odd_texts(spark, monkeypatch):
    """Blocks of any size give the same; nulls, equal rows, clashing columns and an empty table."""
    t = alignment.Tokenizers(*FILES)
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "a b")]
    want = sorted(zip((k if k is not None else -1 for k, _ in rows), expected(t, [x for _, x in rows]), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (alignment.BLOCK_BYTES, 1, 50):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        got = alignment.aligned_documents(docs.withColumns({"block": F.lit("x"), "units": F.lit(1), "first": F.lit(2)}).coalesce(2), *FILES).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, of(r)) for r in got) == want
    assert alignment.aligned_documents(docs.limit(0), *FILES).count() == 0


def test_query_by_walking(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, expected(alignment.Tokenizers(*FILES), texts.values()), strict=True))
    assert {r.doc_id: of(r) for r in queries.op11_cross_tokenizer_alignment(spark, sf_dir).collect()} == want
