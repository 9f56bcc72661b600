"""The string kernel by sets of substrings, on the given documents."""

import numpy as np
import pytest

from tidemark.llm import language


def substrings(text):
    kept = ""
    for c in (text or "").lower():
        if c.isalpha():
            kept += c
        elif kept and kept[-1] != " ":
            kept += " "
    return {kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)} if kept else set()


def kernel(a, b):
    return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])


def test_predictions_by_explicit_kernels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    rows = [(substrings(r.text), r.lang) for r in language.training_rows(docs).collect()]
    rows = [(s, y) for s, y in rows if s]
    names = sorted({y for _, y in rows})
    marks = [s for n in names for s in [s for s, y in rows if y == n][: language.LANDMARKS_PER_LANGUAGE]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel([s for s, _ in rows], marks) @ root
    wanted = np.array([[1.0 if y == n else -1.0 for n in names] for _, y in rows])
    solved = np.linalg.solve(features.T @ features + language.RIDGE * len(rows) * np.eye(features.shape[1]), features.T @ wanted)
    texts = {r.doc_id: substrings(r.text) for r in docs.collect()}
    asked = [k for k, s in texts.items() if s]
    found = kernel([texts[k] for k in asked], marks) @ root @ solved
    for k, scores in zip(asked, found, strict=True):
        assert got[k].score == pytest.approx(min(1, max(0, (scores.max() + 1) / 2)), abs=2e-3)
        if np.sort(scores)[-1] - np.sort(scores)[-2] > 0.01:
            assert got[k].lang_pred == names[int(scores.argmax())]
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k, s in texts.items() if not s)
