"""Language identification with a string kernel.

The kernel counts the character n-grams, n from 1 to 3, that two texts both
hold (presence, not frequency; lower case, all but letters as one space),
divided by the root of the product of their own counts. Landmarks from the
training rows give Nyström features, on which one-versus-rest ridge regression
is solved; all of that folds into one matrix over the landmarks' n-grams. A
batch of texts is then scored by one matrix product of its presence matrix.

The fit takes at most ``TRAIN_PER_LANGUAGE`` rows of each language and
``TRAIN_ROWS`` in all (one of each language at least), those of least hash, of which ``LANDMARKS_PER_LANGUAGE`` are landmarks: a fixed bound,
found by a top-k per task before anything is shuffled. Scoring covers every row
and whole texts.

Defined cases: null text or none with a letter gives ``und`` and score 0; a null
lang is never learned; equal rows count once in the fit; without training rows
everything is ``und``; an empty table gives an empty one; ties go to the first
language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN_PER_LANGUAGE = 300
TRAIN_ROWS = 30_000
LANDMARKS_PER_LANGUAGE = 48
RIDGE = 1e-2
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Sorted distinct n-grams of a text, as numbers; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]  # one space where a letter goes before
    pairs = (points[:-1] << 21) | points[1:]
    return np.unique(np.concatenate([points, pairs, (pairs[:-1] << 21) | points[2:]]))


@dataclass
class Model:
    """Weights over the landmarks' n-grams."""

    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, languages), for texts that have n-grams."""
        return presence(sets, self.vocabulary) @ self.weights / np.sqrt([[len(s)] for s in sets])


def presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, s in enumerate(sets):
        at = np.searchsorted(vocabulary, s)
        at[at == len(vocabulary)] = 0
        out[row, at[vocabulary[at] == s]] = 1
    return out


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström features; the first rows of each language are landmarks."""
    rows = [(s, y) for s, y in ((ngrams(t), y) for t, y in zip(texts, labels, strict=True)) if len(s)]
    languages = sorted({y for _, y in rows})
    chosen = [s for name in languages for s in [s for s, y in rows if y == name][:landmarks]]
    if not chosen:
        return Model([], np.empty(0, np.int64), np.empty((0, 0)))
    vocabulary = np.unique(np.concatenate(chosen))
    marks = presence(chosen, vocabulary) / np.sqrt([[len(s)] for s in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.vstack([(presence([s for s, _ in rows[k : k + 256]], vocabulary) @ marks.T) / np.sqrt([[len(s)] for s, _ in rows[k : k + 256]]) @ root for k in range(0, len(rows), 256)])
    wanted = np.array([[1.0 if y == name else -1.0 for name in languages] for _, y in rows])
    solved = np.linalg.solve(features.T @ features + ridge * len(rows) * np.eye(features.shape[1]), features.T @ wanted)
    return Model(languages, vocabulary, (marks.T @ (root @ solved)).astype(np.float32))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, most: int = TRAIN_ROWS) -> DataFrame:
    """text, lang of at most so many rows of each language, and in all unless there are more languages; none of them held out."""
    open_rows = docs.filter(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    languages = open_rows.select("lang").distinct().count()
    per_language = max(1, min(per_language, most // max(1, languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = open_rows.select("doc_id", "lang").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language).select("doc_id", "lang").distinct()
    # at most per_language ids a language
    texts = open_rows.filter(F.col("text").isNotNull()).join(F.broadcast(ids), ["doc_id", "lang"])
    return texts.groupBy("lang", "doc_id").agg(F.max("text").alias("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").select("text", "lang")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows if model.languages else 0, 64):
                sets = [ngrams(t or "") for t in batch["text"][at : at + 64].to_pylist()]
                rows = [k for k, s in enumerate(sets) if len(s)]
                if not rows:
                    continue
                found = model.scores([sets[k] for k in rows])
                for k, best, score in zip(rows, found.argmax(1), np.clip((found.max(1) + 1) / 2, 0, 1), strict=True):
                    names[at + k], scores[at + k] = model.languages[best], score
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the labelled rows that are not held out."""
    rows = training_rows(docs).toArrow()
    model = fit(rows["text"].to_pylist(), rows["lang"].to_pylist())
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
