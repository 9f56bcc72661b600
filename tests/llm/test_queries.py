"""The registered queries against their SQL and brute force, and the pipeline against plain Python."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from tests.test_queries import plain, same
from tidemark.llm import queries
from tidemark.llm.contamination import CONTAINMENT
from tidemark.llm.shingles import shingle_sets

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, db, name):
    df, want = queries.queries()[name](spark, sf_dir), db.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got, expected = plain(df.collect(), df.columns, names), plain(want.fetchall(), list(want.columns), names)
    assert len(got) == len(expected) and all(same(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


def test_html_by_article(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op3_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_sharding(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(24))


def test_tokens(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op6_token_counts(spark, sf_dir).collect()}
    assert got == {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


def test_language_held_out(spark, sf_dir):
    rows = queries.op8_language_identification(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_pipeline_by_brute_force(spark, sf_dir):
    """Stage by stage on what the stage before kept, each by plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toArrow()
    items = [s for _, s in shingle_sets(bench["text"], 5)]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        before, after = docs.toArrow(), out.toArrow()
        kept = after["doc_id"].to_pylist()
        sets = dict(zip(before["doc_id"].to_pylist(), (set(s.tolist()) for _, s in shingle_sets(before["text"], 5)), strict=True))
        if name == "quality_rules":
            verdicts = {r.doc_id: r.kept for r in queries.quality.cross_document_lines(docs).collect()}
            assert sorted(kept) == sorted(k for k, v in verdicts.items() if v) and kept
        elif name == "minhash_near_dedup":
            ids, root = sorted(sets), {}
            for i, a in enumerate(ids):
                root[a] = a
                for b in ids[:i]:
                    c = len(sets[a] & sets[b])
                    if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                        x, y = sorted((_find(root, a), _find(root, b)))
                        root[y] = x
            assert sorted(kept) == sorted(k for k in ids if _find(root, k) == k)
        elif name == "benchmark_decontamination":
            assert sorted(kept) == sorted(k for k, s in sets.items() if not any(len(q) and len(s & set(q.tolist())) >= CONTAINMENT * len(q) for q in items))
        elif name == "source_mixing":
            words = {k: len((t or "").split()) for k, t in zip(before["doc_id"].to_pylist(), before["text"].to_pylist(), strict=True)}
            assert max(kept.count(k) for k in set(kept)) <= 2
            assert sum(words[k] for k in kept) == pytest.approx(1.5 * sum(words.values()), rel=0.1)
        else:
            assert sorted(kept) == sorted(before["doc_id"].to_pylist())
            counts = [after["shard"].to_pylist().count(s) for s in range(24)]
            assert max(counts) - min(counts) <= 1
        if name != "sharding":
            assert out.columns == docs.columns
        docs = out


def _find(root, a):
    while root[a] != a:
        a = root[a]
    return a
