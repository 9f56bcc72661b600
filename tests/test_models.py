"""Models on small tables whose answers are known, and on the given ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import QUERIES, learning, streams


@pytest.fixture(scope="module")
def rows(spark):
    """Six periods of forty rows; the outcome is whether the mid is above one half."""
    draw = random.Random(3)
    made = []
    for k in range(240):
        mid = round(draw.random() * 0.98 + 0.01, 3)
        made.append((k, "abc"[k % 3], f"T{k // 40}-{k % 3}", k // 40, k * 1_000_000, int(mid > 0.5), *[mid if f == "mid" else draw.random() for f in learning.FEATURES]))
    schema = "seq long, asset string, ticker string, period_id long, us long, y int, " + ", ".join(f"{f} double" for f in learning.FEATURES)
    return learning.staged(spark.createDataFrame(made, schema), "rows")


def test_missing_features_are_zero(spark):
    schema = ", ".join(f"{f} double" for f in learning.FEATURES)
    row = learning.vectors(spark.createDataFrame([(0.5, *[None] * 13)], schema)).first()
    assert tuple(row) == (0.5, *[0.0] * 13) and len(learning.FEATURES) == 14


def test_sizes_of_the_models(spark):
    large, small = (p.getStages()[-1] for p in (learning.trees(), learning.small_trees()))
    assert (large.getMaxIter(), large.getMaxDepth(), large.getStepSize(), large.getSubsamplingRate()) == (100, 4, 0.1, 0.8)
    assert (small.getMaxIter(), small.getMaxDepth(), small.getMinInstancesPerNode()) == (50, 3, 10)


def test_walk_forward_has_a_fold_for_each_period(rows, monkeypatch):
    monkeypatch.setattr(learning, "SMALL_ROUNDS", 8)
    _, folds = learning.folds_of(rows)
    assert sorted(map(tuple, folds.collect())) == [(k, 40 * k, 40, rows.filter(F.col("period_id") == k).filter("y = 1").count()) for k in range(2, 6)]
    scored = learning.walk_forward(rows).collect()
    assert sorted({(r.fold, r.n_train) for r in scored}) == [(k, 40 * k) for k in range(2, 6)] and len(scored) == 160
    assert sum((r.prob > 0.5) == (r.y == 1) for r in scored) > 150
    assert learning.walk_forward(rows.filter("y = 1")) is None
    assert learning.walk_forward(rows.filter("period_id < 2")) is None


def test_a_fold_knows_nothing_of_its_own_period(spark, rows, monkeypatch):
    """Other outcomes of the last period change no probability; those of an earlier one do."""
    monkeypatch.setattr(learning, "SMALL_ROUNDS", 2)
    flipped = lambda p: learning.staged(rows.withColumn("y", F.when(F.col("period_id") == p, 1 - F.col("y")).otherwise(F.col("y"))), "flipped")
    probs = lambda x: {r.seq: r.prob for r in learning.walk_forward(x).collect()}
    base, last, early = probs(rows), probs(flipped(5)), probs(flipped(3))
    assert base == last
    assert {k: base[k] for k in range(80, 160)} == {k: early[k] for k in range(80, 160)} and any(base[k] != early[k] for k in range(160, 240))


def test_continued_trees_against_plain_sums(spark):
    """One tree of depth one on two columns, by hand; and exclusive or, which needs two levels."""
    from tidemark.operators import boosting

    draw = random.Random(5)
    made = [(round(draw.random(), 2), round(draw.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, int(a > 0.5), int((a > 0.5) != (b > 0.5)), k % 2) for k, (a, b) in enumerate(made)], "a double, b double, y int, x int, stretch int").repartition(3)
    model = boosting.continued(boosting.begin(df, ["a", "b"], "y", depth=1, least=1), df, "y", 0)
    (tree,) = model.trees
    edge = model.edges[0][tree.cuts[0]]
    p = 1 / (1 + math.exp(-model.base))
    sides = [[a > 0.5 for a, _ in made if (a > edge) == right] for right in (False, True)]
    assert tree.features[0] == 0 and abs(edge - 0.5) < 0.05
    assert tree.values.tolist() == pytest.approx([-0.1 * sum(p - y for y in s) / (len(s) * p * (1 - p) + 1) for s in sides])
    model = boosting.continued(boosting.begin(df, ["a", "b"], "x"), df, "x", 1, 40)
    scored = boosting.scored(model, df, "stretch").collect()
    assert all((r.prob > 0.5) == (r.x == 1) for r in scored if r.stretch == 1 and abs(r.a - 0.5) > 0.05 and abs(r.b - 0.5) > 0.05)
    assert all(r.prob == pytest.approx(1 / (1 + math.exp(-model.base))) for r in scored if r.stretch == 0)


def test_a_level_is_one_job_over_bins(spark, rows):
    """Rows binned once give the trees that their columns give; each level of a tree is one job."""
    from tidemark.operators import boosting

    model = boosting.begin(rows, learning.FEATURES, "y")
    held = learning.staged(boosting.binned(model, rows.select("seq", "period_id", "y", *learning.FEATURES)), "held")
    assert held.columns == ["seq", "period_id", "y", boosting.BINS]
    spark.sparkContext.setJobGroup("levels", "levels")
    grown = boosting.continued(model, held, "y", 2, 3)
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels")) == 9
    plain = boosting.continued(model, rows, "y", 2, 3)
    for a, b in zip(grown.trees, plain.trees, strict=True):
        assert (a.features == b.features).all() and (a.cuts == b.cuts).all() and a.values == pytest.approx(b.values)
    of_bins, of_columns = ({r.seq: r.prob for r in boosting.scored(grown, t, "period_id").collect()} for t in (held, rows))
    assert of_bins == of_columns and len({p for k, p in of_bins.items() if k < 80}) == 1 < len(set(of_bins.values()))


@pytest.mark.parametrize("name", ["walk_forward_cv", "online_retrain", "train_gbt", "ml_signal"])
def test_registered_models_at_full_size(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).collect()
    if name == "walk_forward_cv":
        folds = QUERIES["walk_forward_folds"](spark, sf_dir).collect()
        assert sorted((r.fold, r.n_train, r.n, r.n_yes) for r in got if r.fold is not None) == sorted(map(tuple, folds)) and len(folds) > 20
        (whole,) = (r for r in got if r.fold is None)
        assert whole.n == sum(r.n for r in folds) and 0 < whole.brier < 0.3
    else:
        assert got and all(0 < r.prob < 1 for r in got)


def test_scores_by_hand(spark):
    got = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.2, 0), (0.5, 0)], "prob double, y int").agg(*learning._report()).first()
    assert (got.n, got.n_yes, got.accuracy) == (4, 2, 0.5) and got.brier == pytest.approx((0.01 + 0.36 + 0.04 + 0.25) / 4)


def test_strategy_of_a_model(rows):
    model = learning.trees(3, 3).fit(rows)
    out = learning.ml_strategy(model).apply(rows).collect()
    assert all(r.side == ("YES" if r.prob > r.mid else "NO" if r.prob < r.mid else None) and r.edge == abs(r.prob - r.mid) and r.info == {"model_p": r.prob} for r in out)


def test_the_retrained_model_is_a_strategy(rows, monkeypatch):
    """Only rows of folds are decided, by probabilities that walk_forward gives."""
    from tidemark.plans.signals import apply_strategy

    monkeypatch.setattr(learning, "SMALL_ROUNDS", 3)
    want = {r.seq: r.prob for r in learning.walk_forward(rows).collect()}
    assert {r.seq: r.prob for r in apply_strategy(rows, "model").collect()} == want and len(want) == 160
    assert apply_strategy(rows.filter("period_id < 2"), "model").count() == 0


def test_backtest_of_the_model(spark, sf_dir):
    """Trades are those that the gates let through: one for each contract and configuration at most, sized and settled."""
    got = QUERIES["backtest_model"](spark, sf_dir).collect()
    assert len({(r.config, r.ticker) for r in got}) == len(got)
    assert all(r.side in ("YES", "NO") and r.contracts > 0 and r.fee >= 0 and r.pnl is not None for r in got)


def test_training_rows_are_dealt_by_their_number(rows, monkeypatch):
    monkeypatch.setattr(learning, "PART_ROWS", 50)
    held = learning.dealt(rows.coalesce(1))
    assert held.rdd.getNumPartitions() == 5 and sorted(r.seq for r in held.collect()) == list(range(240))
    monkeypatch.setattr(learning, "PART_ROWS", 240)
    assert learning.dealt(rows.coalesce(1)).rdd.getNumPartitions() == 1


def test_two_classes(rows):
    assert learning.two_classes(rows) and not learning.two_classes(rows.filter("y = 0")) and not learning.two_classes(rows.limit(29))


@pytest.mark.parametrize("name", ["train_logreg", "train_gbt_small", "feature_importance"])
def test_registered_models(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(learning, "SMALL_ROUNDS", 5)
    got = QUERIES[name](spark, sf_dir).collect()
    if name == "feature_importance":
        assert len(got) == 10 and got[0].relative == 1 and [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)
    else:
        assert got[0].n > 0 and 0 <= got[0].brier <= 1


def test_stream_scores_are_the_batch_scores(spark, sf_dir):
    """Every row of the slots that have closed, with the batch's features and score."""
    rows = learning.samples(spark, sf_dir)
    model = learning.logistic(rows.count()).fit(rows)
    want = {r.seq: r.prob for r in learning.score(model, rows).filter(F.col("us") < closed_until(spark, sf_dir)).collect()}
    got = {r.seq: r.prob for r in streams.stream_scores(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(got) > 900 and all(got[k] == pytest.approx(p, rel=1e-9) for k, p in want.items())


def closed_until(spark, sf_dir, slot_us=21_600_000_000):
    top = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return (top - 300_000_000) // slot_us * slot_us


def test_strategies_keep_the_contract(spark, sf_dir):
    import pandas as pd

    from tidemark.plans.signals import CONTRACT, STRATEGIES, Strategy, apply_strategy, features, pandas_strategy

    t = learning.staged(features(spark, sf_dir, clock=True), "strategy-features")
    for name in ("rule", "consensus"):
        assert set(CONTRACT) <= set(apply_strategy(t, name).columns)
    fade = lambda f: pd.DataFrame({"side": ["NO" if x > 0 else "YES" for x in f["ob_imbalance"]], "edge": f["ob_imbalance"].abs(), "prob": 0.5, "info": [{"imbalance": x} for x in f["ob_imbalance"]]})
    bad = [lambda x: x.select("seq", F.lit("YES").alias("side")), lambda x: x.withColumns({"side": F.lit("YES"), "edge": F.lit(1), "prob": F.lit(0.5), "info": F.create_map(F.lit("a"), F.lit(1.0))})]
    STRATEGIES["fade"] = pandas_strategy(fade)
    try:
        got = apply_strategy(t.filter("ob_imbalance is not null"), "fade").collect()
        assert len(got) > 900 and all(r.side == ("NO" if r.ob_imbalance > 0 else "YES") and r.edge == abs(r.ob_imbalance) and r.info == {"imbalance": r.ob_imbalance} for r in got)
        for f in bad:
            STRATEGIES["bad"] = Strategy(f)
            with pytest.raises(ValueError, match="edge"):
                apply_strategy(t, "bad")
    finally:
        STRATEGIES.pop("fade"), STRATEGIES.pop("bad", None)


def test_a_stale_price_invalidates_a_tick(spark, sf_dir):
    got = QUERIES["model_signals"](spark, sf_dir).collect()
    assert sum(r.stale > 60 for r in got) > 5 and not any(r.valid for r in got if r.stale > 60)
