"""Quality rules: text statistics and lines that recur across a host's documents (DataFrame functions only).

``cross_document_lines`` hashes normalised lines (lower case, white space runs
as one space, trimmed), counts the distinct texts of each host (``source``)
that hold them, and calls a line recurring if that count is at least
``min_docs`` and ``max_share`` of the host's distinct texts. A recurring line is
frequent unless over half of its texts are near copies of one another: the body
of a document that was copied often is not a line of the host. Texts are of one
family if they share their least line that does not recur. Only a text that is
a near copy as a whole (recurring lines hold over half of its words, or over six
sevenths for a line on over half of the host's texts) is of the family of its
least other recurring line. Frequent lines are removed; a document is rejected
when over ``max_removed`` of its words went with them, or when a base rule fails.

Defined cases: null text counts as empty and fails the base rule; a null source
is the host of that name ''; repeated rows get equal verdicts; other columns
pass through untouched (``cross_document_lines`` and ``text_statistics`` raise on
their own output's names; ``clean_documents`` takes any); an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 10
MAX_SHARE = 0.005
MAX_REMOVED = 0.5
COPY_PARTS = 7  # near copies that share three quarters of their words in all have under a seventh of their own
WINDOW = 3


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""
    hashes = F.slice(F.transform(w, lambda _, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, j: F.coalesce(e["x"] == F.get(s, j - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, j + 1)["x"], F.lit(False))))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = let(at, lambda p: F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), v + WINDOW) - v)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICT = (*STATISTICS, "n_removed_words", "kept")


def _free(df: DataFrame, names: tuple[str, ...]) -> None:
    taken = set(names) & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")


def _with_statistics(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn("words", words(F.col("text"))).withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(F.col("words"), _repeat_words),  # let: a filter that is pushed down may inline the words
    }).drop("words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _packed(df: DataFrame) -> Column:
    """df's columns but the text in one struct, so that their names don't matter."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]).alias("row")


def text_statistics(df: DataFrame) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    _free(df, STATISTICS)
    return _with_statistics(df.select(_packed(df), "text")).select(*[F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in df.columns], *STATISTICS)


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def _row_keys() -> list[Column]:
    """Two hashes of what a verdict depends on, so that no 64-bit clash joins two rows."""
    return [F.xxhash64("doc_id", "source", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("k2")]


def _measured(df: DataFrame, row: Column) -> DataFrame:
    """All that is taken from the texts, in one pass over them that is written: row, k1, k2, host, held (text's hash; null for a null text), cells (line, words) and the statistics."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), _normal), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("words")))
    rows = df.select(row, "text", *_row_keys(), F.coalesce("source", F.lit("")).alias("host"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("held"), cells.alias("cells"))
    return written(_with_statistics(rows).drop("text"), "measured")


def _frequent(measured: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(k1, k2, hits, removed): the frequent lines of their host that documents hold, with the words in them."""
    full = measured.filter("held is not null")
    # equal texts of a host count once
    placed = full.select("host", "held", F.explode("cells").alias("cell")).select("host", "held", "cell.line", "cell.words")
    counted = placed.groupBy("host", "line").agg(F.count("*").alias("n"))
    sizes = full.select("host", "held").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    # a line's number of texts is at most its number of places: this only narrows the exact count below
    candidates = written(counted.filter(F.col("n") >= min_docs).join(sizes, "host").filter(F.col("n") >= max_share * F.col("texts")).select("host", "line", "texts"), "line-candidates")
    shared = placed.join(candidates, ["host", "line"]).select("host", "line", "texts", "held").distinct()
    exact = shared.groupBy("host", "line", "texts").agg(F.count("*").alias("docs"))
    recurring = written(exact.filter((F.col("docs") >= min_docs) & (F.col("docs") >= max_share * F.col("texts"))), "recurring-lines")

    known = recurring.select("host", "line", F.lit(True).alias("known"))
    own = F.col("known").isNull()
    texts = (
        placed.join(known, ["host", "line"], "left").groupBy("host", "held")
        .agg(F.min(F.when(own, F.col("line"))).alias("own"), F.sum(F.when(own, F.col("words")).otherwise(0)).alias("own_words"), F.sum("words").alias("all_words"))
        .filter(F.col("own_words") < F.col("all_words"))
    )
    shared = written(placed.join(recurring, ["host", "line"]).select("host", "line", "texts", "docs", "held").distinct(), "line-texts")
    least = shared.groupBy("host", "held").agg(F.array_sort(F.collect_set("line")).alias("s")).select("host", "held", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"))
    parts = F.when(2 * F.col("docs") > F.col("texts"), COPY_PARTS).otherwise(2)
    other = F.when(parts * F.col("own_words") < F.col("all_words"), F.when(F.col("line") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    families = (
        shared.join(least, ["host", "held"]).join(texts, ["host", "held"]).withColumn("family", F.coalesce(other, F.col("own")))
        .groupBy("host", "line", "docs", "family").agg(F.count("*").alias("n"))
        .groupBy("host", "line", "docs").agg(F.max("n").alias("largest"))
    )
    frequent = families.filter(2 * F.col("largest") <= F.col("docs")).select("host", "line")
    numbered = full.select("host", "k1", "k2", F.monotonically_increasing_id().alias("at"), "cells")  # before the lines are exploded
    rows = numbered.select("host", "k1", "k2", "at", F.explode("cells").alias("cell")).select("host", "k1", "k2", "at", "cell.line", "cell.words")
    one = rows.join(frequent, ["host", "line"]).groupBy("k1", "k2", "at").agg(F.collect_set("line").alias("hits"), F.sum("words").alias("removed"))
    # equal rows have equal entries
    return one.groupBy("k1", "k2").agg(F.first("hits").alias("hits"), F.first("removed").alias("removed"))


def _judged(measured: DataFrame, min_docs: int, max_share: float, max_removed: float) -> DataFrame:
    """measured with hits, n_removed_words and kept."""
    joined = measured.drop("cells").join(_frequent(measured, min_docs, max_share), ["k1", "k2"], "left")
    removed = F.coalesce(F.col("removed"), F.lit(0).cast("long"))
    return joined.withColumn("n_removed_words", removed).withColumn("kept", ~(F.col("base_failed") | (removed > max_removed * F.col("n_words"))))


def cross_document_lines(df: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """df but its text with the statistics, n_removed_words (in frequent lines), base_failed and kept."""
    _free(df, VERDICT)
    return _judged(_measured(df, _packed(df)), min_docs, max_share, max_removed).select("row.*", *VERDICT)


def clean_documents(df: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The kept rows with df's columns, frequent lines taken out of their text (and n_chars set anew where it is a column)."""
    verdicts = _judged(_measured(df, F.lit(0).alias("row")), min_docs, max_share, max_removed).filter("kept")
    verdicts = verdicts.groupBy("k1", "k2").agg(F.first("hits").alias("hits"))
    kept = df.select(_packed(df), "text", *_row_keys()).join(verdicts, ["k1", "k2"])
    rest = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x: ~F.array_contains(F.col("hits"), F.xxhash64(_normal(x)))), "\n")
    cleaned = kept.select("row", F.when(F.col("hits").isNull(), F.col("text")).otherwise(rest).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text")}
    return cleaned.select(*[made[c].cast(df.schema[c].dataType).alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in df.columns])
