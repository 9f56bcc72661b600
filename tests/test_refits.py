"""Models fitted anew for each stretch: against a plain fit, against fits of their own, and the folds that use them."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import refits
from tidemark.plans import learning

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Six stretches of sixty rows; the outcome depends on a, from the fourth stretch on the other way round."""
    draw, made = random.Random(11), []
    for k in range(360):
        a, b, c = draw.random(), round(draw.random(), 1), draw.gauss(0, 1)
        made.append((k * 7 - 500, k // 60, a, b, c, int((a > 0.5) != (k >= 180) if draw.random() < 0.9 else draw.random() < 0.5)))
    return learning.staged(spark.createDataFrame(made, "seq long, period int, a double, b double, c double, y int"), "refit-rows")


def fitted(rows, starts, rounds=4):
    return refits.refitted(rows, COLUMNS, "y", "seq", "period", starts, rounds, share=0.8, seed=7, depth=3, step=0.1, least=10)


def alike(one, other):
    assert one.base == other.base and len(one.trees) == len(other.trees) and all((a == b).all() for a, b in zip(one.edges, other.edges, strict=True))
    assert all((s.features == t.features).all() and (s.cuts == t.cuts).all() and (s.values == t.values).all() for s, t in zip(one.trees, other.trees, strict=True))


def plain(model, held, rounds):
    """The odds of held rows (seq, values, y) by a fit to them with the model's edges, row by row."""
    bins = [[sum(e < v for e in edges) for v, edges in zip(values, model.edges, strict=True)] for _, values, _ in held]
    mean = sum(y for *_, y in held) / len(held)
    odds = [math.log(mean / (1 - mean))] * len(held)
    for r in range(rounds):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        inside = set(np.flatnonzero(refits.drawn(np.array([s for s, *_ in held]), r, 0.8, 7)).tolist())

        def gradients(at, p=p):
            return sum(p[i] - held[i][2] for i in at)

        def grow(at, depth, p=p, inside=inside):
            drawn = [i for i in at if i in inside]
            best = (1e-9, None)
            for f in range(len(COLUMNS) if depth else 0):
                for cut in range(32):
                    left, right = ([i for i in drawn if (bins[i][f] <= cut) == side] for side in (True, False))
                    if min(len(left), len(right)) >= 10:
                        gain = gradients(left) ** 2 / len(left) + gradients(right) ** 2 / len(right) - gradients(drawn) ** 2 / len(drawn)
                        best = max(best, (gain, (f, cut)), key=lambda x: x[0])
            if best[1]:
                f, cut = best[1]
                return grow([i for i in at if bins[i][f] <= cut], depth - 1) | grow([i for i in at if bins[i][f] > cut], depth - 1)
            curvature = sum(p[i] * (1 - p[i]) for i in drawn)
            return dict.fromkeys(at, -0.1 * gradients(drawn) / curvature if drawn else 0.0)

        steps = grow(range(len(held)), 3)
        odds = [o + steps[i] for i, o in enumerate(odds)]
    return odds


def test_each_model_is_a_fit_of_its_own_to_all_rows_before(rows):
    models = fitted(rows, [2, 5])
    table = sorted(map(tuple, rows.collect()))
    for start, model in models.items():
        held = [(seq, values, y) for seq, period, *values, y in table if period < start]
        assert len(model.trees) == 4 and len(held) == 60 * start
        for k, edges in enumerate(model.edges):
            shares = [sum(v[k] <= e for _, v, _ in held) / len(held) for e in edges]
            if k != 1:
                assert len(edges) == 31 and shares == pytest.approx([j / 32 for j in range(1, 32)], abs=0.02)
        bins = np.array([[sum(e < v for e in edges) for v, edges in zip(values, model.edges, strict=True)] for _, values, _ in held], np.uint8).T
        assert model.margins(bins).tolist() == pytest.approx(plain(model, held, 4), abs=1e-5)


def test_models_do_not_depend_on_their_company(rows, monkeypatch):
    """Nor on how rows are dealt to blocks, cells, tasks and passes."""
    models = fitted(rows, [2, 3, 4, 5])
    alike(models[4], fitted(rows, [4])[4])
    for name, value in {"BLOCK": 17, "GROUP": 1, "TOGETHER": 2, "TASK_ODDS": 100, "SUMS_BYTES": 0}.items():
        monkeypatch.setattr(refits, name, value)
    others = fitted(rows.repartition(5, "a"), [2, 3, 4, 5])
    for start in models:
        alike(models[start], others[start])


def test_a_share_of_the_rows_is_drawn_for_each_round():
    keys = np.arange(-20_000, 20_000)
    first, second = (refits.drawn(keys, r, 0.8, 7) for r in (0, 1))
    assert abs(first.mean() - 0.8) < 0.01 and abs((first & second).mean() - 0.64) < 0.01
    assert (refits.drawn(keys[::-1].copy(), 0, 0.8, 7) == first[::-1]).all() and refits.drawn(keys, 3, 1.0, 7).all()


@pytest.fixture(scope="module")
def samples(spark):
    """Twelve periods of forty rows and three contracts; the outcome is whether the mid is above one half, from the seventh period on the other way round."""
    draw, made = random.Random(3), []
    for k in range(480):
        mid, period = round(draw.random() * 0.98 + 0.01, 3), k // 40
        made.append((k, "abc"[k % 3], f"T{period}-{k % 3}", period, k * 1_000_000, int((mid > 0.5) != (period >= 6)), *[mid if f == "mid" else draw.random() for f in learning.FEATURES]))
    schema = "seq long, asset string, ticker string, period_id long, us long, y int, " + ", ".join(f"{f} double" for f in learning.FEATURES)
    return learning.staged(spark.createDataFrame(made, schema), "refit-samples")


def test_a_fold_is_fitted_to_all_periods_before(samples, monkeypatch):
    """What held in the first six periods is not held against the last ones by trees of models before: a fold is that of a walk that begins with it."""
    monkeypatch.setattr(learning, "SMALL_ROUNDS", 5)
    probs = {r.seq: r.prob for r in learning.walk_forward(samples).collect() if r.fold == 11}
    _, folds = learning.folds_of(samples)
    monkeypatch.setattr(learning, "folds_of", lambda rows, tested=True: (learning_placed(rows), folds.filter("fold = 11")))
    assert len(probs) == 40 and probs == {r.seq: r.prob for r in learning.walk_forward(samples).collect()}


def learning_placed(rows):
    return learning.staged(rows.withColumn("period", rows["period_id"].cast("int")), "placed", by="period")


def test_retraining_scores_all_rows_since_the_first_model(spark, samples, monkeypatch):
    """Periods of a few rows and the second period have a model too, if four contracts with both outcomes and thirty rows lie before; only a test asks for more."""
    monkeypatch.setattr(learning, "SMALL_ROUNDS", 2)
    few = samples.filter("seq % 5 = 0").withColumn("ticker", learning.F.concat("ticker", learning.F.expr("seq % 2")))  # eight rows and six contracts a period
    monkeypatch.setattr(learning, "samples", lambda spark, sf_dir: few)
    got = learning.online_retrain(spark, "").collect()
    assert sorted((r.seq, r.fold) for r in got) == [(k, k // 40) for k in range(160, 480, 5)] and all(0 < r.prob < 1 for r in got)
    many = samples.withColumn("ticker", learning.F.concat("ticker", learning.F.expr("seq % 2")))
    monkeypatch.setattr(learning, "samples", lambda spark, sf_dir: many)
    assert {r.fold for r in learning.online_retrain(spark, "").collect()} == set(range(1, 12))
    assert {r.fold for r in learning.walk_forward_cv(spark, "").collect()} == {None, *range(2, 12)}
