"""Queries over models: features, trees, logistic regression, importances, walk-forward folds, retraining."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.refits import refitted, scored_at
from ..sources.staging import staged
from .registry import query
from .signals import _SAMPLES, FEATURES, STRATEGIES, Strategy, backtest, feature_samples, info, numbered_periods, timed_parts

#: Trees of the two models, the folds' least sizes, the least settled contracts of a retraining.
ROUNDS, SMALL_ROUNDS = 100, 50
LEAST_TRAIN, LEAST_TEST, LEAST_SETTLED, SEED = 30, 10, 4, 7
#: The share of the training rows that a tree of the folds' models is fitted to.
SMALL_SHARE = 0.8
#: Rows of a partition that MLlib's trees and regressions keep and read again for each level or step.
PART_ROWS = 100_000


def vectors(rows: DataFrame) -> DataFrame:
    """M1: missing features are 0."""
    return rows.na.fill(0.0, FEATURES)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def trees(rounds: int = ROUNDS, depth: int = 4, leaf: int = 1) -> Pipeline:
    """M2: boosted trees; columns are drawn for each node."""
    model = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=leaf, seed=SEED)
    return Pipeline(stages=[assembler(), model])


def small_trees() -> Pipeline:
    """M3."""
    return trees(SMALL_ROUNDS, 3, 10)


def logistic(rows: int) -> Pipeline:
    """M4: scaled features, penalty of one over the number of rows."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[assembler(), scaler, LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=1000, regParam=1 / max(rows, 1))])


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """M5, ST11: rows with prob; the same on a stream."""
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1])


def two_classes(rows: DataFrame, least: int = LEAST_TRAIN) -> bool:
    n, low, high = rows.agg(F.count("*"), F.min("y"), F.max("y")).first()
    return n >= least and low != high


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(vectors(feature_samples(spark, sf_dir)), "samples")


def dealt(rows: DataFrame) -> DataFrame:
    """rows in partitions of about PART_ROWS: files are split by compressed bytes, which may hold any number of rows."""
    parts = -(-rows.count() // PART_ROWS)
    return rows.repartition(parts, "seq") if parts > 1 else rows


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first four fifths of the rows by time, and the rest."""
    rows = staged(timed_parts(samples(spark, sf_dir)), "parts")
    return dealt(rows.filter("part = 'train'")), rows.filter("part = 'test'")


def _report() -> list[Column]:
    right = ((F.col("prob") >= 0.5) == (F.col("y") == 1)).cast("int")
    return [F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_yes"), F.avg(right).alias("accuracy"), F.avg(F.pow(F.col("prob") - F.col("y"), 2)).alias("brier")]


@query()
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M5, C4: predictions on the later rows."""
    train, test = _training(spark, sf_dir)
    return score(trees().fit(train), test).select("seq", "asset", "y", "prob")


@query()
def train_gbt_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the small model's accuracy and Brier score; no row below the least training rows or with one class."""
    train, test = _training(spark, sf_dir)
    if not two_classes(train):
        return spark.createDataFrame([], "n long, n_yes long, accuracy double, brier double")
    return score(small_trees().fit(train), test).agg(*_report())


@query()
def train_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: accuracy and Brier score."""
    train, test = _training(spark, sf_dir)
    return score(logistic(train.count()).fit(train), test).agg(*_report())


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, L4: the ten largest importances, relative to the largest."""
    train, _ = _training(spark, sf_dir)
    weights = small_trees().fit(train).stages[-1].featureImportances.toArray()
    most = max(weights) or 1.0
    return spark.createDataFrame([(n, float(w), float(w / most)) for n, w in zip(FEATURES, weights, strict=True)], "feature string, importance double, relative double").orderBy(F.desc("importance")).limit(10)


_FOLDS = _SAMPLES + f""", folds AS (SELECT *, dense_rank() OVER (ORDER BY period_id) - 1 AS period FROM samples), starts AS (SELECT DISTINCT period AS start FROM folds WHERE period >= 2),
sizes AS (SELECT s.start, count(*) AS n_train, count(DISTINCT f.ticker) AS settled, min(y) AS low, max(y) AS high FROM starts s JOIN folds f ON f.period < s.start GROUP BY s.start),
fold_rows AS (SELECT t.period AS fold, any_value(n_train) AS n_train, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_yes FROM folds t JOIN sizes z ON z.start = t.period WHERE n_train >= {LEAST_TRAIN} AND settled >= {LEAST_SETTLED} AND low <> high GROUP BY t.period HAVING count(*) >= {LEAST_TEST})
"""


def folds_of(rows: DataFrame, tested: bool = True) -> tuple[DataFrame, DataFrame]:
    """Staged rows with their period's number, and (fold, n_train, n, n_yes) of every period that can be learned for and, if asked for, tested.

    A fold's model learns from all periods before, whose contracts have settled
    by then: counts of one period each, added up in order. Only a test needs two
    periods before it and its least rows.
    """
    periods = numbered_periods(rows).select("period_id", F.col("fold").alias("period"))
    placed = staged(rows.join(periods, "period_id"), "placed", by="period")
    per = placed.groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_yes"), F.countDistinct("ticker").alias("settled"))
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # a row for each period
    sums = per.select("period", "n", "n_yes", *[F.sum(c).over(before).alias(f"_{c}") for c in ("n", "n_yes", "settled")])
    fit = sums.filter(f"_n >= {LEAST_TRAIN} and _settled >= {LEAST_SETTLED} and _n_yes > 0 and _n_yes < _n")
    if tested:
        fit = fit.filter(f"period >= 2 and n >= {LEAST_TEST}")
    return placed, fit.select(F.col("period").alias("fold"), F.col("_n").alias("n_train"), "n", "n_yes")


def walk_forward(rows: DataFrame, tested: bool = True) -> DataFrame | None:
    """M7, M8: the rows of all folds with fold, n_train and the prob of a model of the periods before; None if there is no fold.

    Each fold's model is M3 fitted anew to all rows of all periods before it; the
    models grow side by side. tested: only folds that can be tested (W19), else
    all for which there is a model.
    """
    placed, folds = folds_of(rows, tested)
    folds = staged(folds, "folds")
    starts = [r.fold for r in folds.select("fold").collect()]  # a number for each period
    if not starts:
        return None
    models = refitted(placed, FEATURES, "y", "seq", "period", starts, SMALL_ROUNDS, share=SMALL_SHARE, seed=SEED, depth=3, step=0.1, least=10)
    held = placed.join(F.broadcast(folds.select(F.col("fold").alias("period"), "n_train")), "period")
    held = held.select("seq", "asset", "period_id", "period", "n_train", "y", *FEATURES)
    return scored_at(models, held, "period").withColumnRenamed("period", "fold").drop(*FEATURES)


@query(_FOLDS + "SELECT fold, n_train, n, n_yes FROM fold_rows")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds, one for each period that can be tested, with their rows."""
    return folds_of(samples(spark, sf_dir))[1]


@query()
def walk_forward_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each fold, and of all of them (fold null)."""
    rows = walk_forward(samples(spark, sf_dir))
    if rows is None:
        return spark.createDataFrame([], "fold int, n_train long, n long, n_yes long, accuracy double, brier double")
    out = rows.groupingSets([[F.col("fold"), F.col("n_train")], []], F.col("fold"), F.col("n_train")).agg(*_report())
    return out.select("fold", "n_train", "n", "n_yes", "accuracy", "brier")


@query()
def online_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the probability of each row since there is a model, by the one that was retrained at the last settlement before it."""
    rows = walk_forward(samples(spark, sf_dir), tested=False)
    if rows is None:
        return spark.createDataFrame([], "seq long, fold int, y int, prob double")
    return rows.select("seq", "fold", "y", "prob")


def market_side(scored_rows: DataFrame) -> DataFrame:
    """Rows with prob and mid to a strategy's columns."""
    edge = F.abs(F.col("prob") - F.col("mid"))
    return scored_rows.withColumns({"side": S.side_of(F.col("prob"), F.col("mid")), "edge": edge, "info": info(model_p=F.col("prob"))})


def ml_strategy(model: PipelineModel) -> Strategy:
    """F2: a strategy that scores rows with the features by a model."""
    return Strategy(lambda t: market_side(score(model, vectors(t))), feature_samples)


def retrained(t: DataFrame) -> DataFrame:
    """F2, M8: feature samples of the folds, by the model that was retrained at the last settlement before each."""
    rows = staged(t, "strategy-rows")
    scored_rows = walk_forward(vectors(rows))
    if scored_rows is None:
        scored_rows = rows.limit(0).withColumn("prob", F.lit(0.5))
    return market_side(rows.join(scored_rows.select("seq", "prob"), "seq"))


STRATEGIES["model"] = Strategy(retrained, feature_samples)


@query()
def ml_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's side and edge on every tick that has a mid."""
    rows = samples(spark, sf_dir)
    train = staged(timed_parts(rows).filter("part = 'train'"), "train")
    return ml_strategy(small_trees().fit(dealt(train))).apply(rows).select("seq", "side", "edge", "prob")


@query()
def backtest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of three configurations on the retrained model's signals."""
    return backtest(spark, sf_dir, "model").select("config", "seq", "ticker", "side", "contracts", "fee", "pnl")
