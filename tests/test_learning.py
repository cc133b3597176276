"""Walk-forward learning: cases, trees, gate, importance; nothing of the future changes a forecast."""

import math
import random

import pytest
from chronosift.operators import splits
from chronosift.plans import learning
from chronosift.sources.store import Steps

N, FOLDS = 320, splits.walk_forward(320, 160, 60, embargo=2)
LEARNER = learning.Learner(rounds=3, embargo=1)


def _rows(spark, n=N, shift=0.0):
    """Two series; the label follows `good` nine times in ten. shift changes bars from 260 on."""
    rng = random.Random(8)
    rows, labels = [], []
    for s in (1, 2):
        for i in range(N):
            good, noise, y = rng.gauss(0, 1), rng.gauss(0, 1), rng.random() < 0.9
            far = shift if i >= 260 else 0.0
            rows.append((s, i, good + far, noise - far, None if i < 5 else 1.0))
            labels.append((s, i, i + 1 + i % 4, float((good > 0) == y)))
    bars = spark.createDataFrame([r for r in rows if r[1] < n], "series_id long, pos long, good double, noise double, late double")
    known = spark.createDataFrame([r for r in labels if r[2] < n], "series_id long, t_idx long, t1_idx long, y double")
    return bars, known


def _fit(spark, bars, known, folds=FOLDS):
    names = ["good", "noise", "late"]
    steps = Steps(spark)
    return learning.fit_folds(learning.fold_cases(bars, names, known, folds, LEARNER, steps), 3, LEARNER, steps), names


@pytest.fixture(scope="module")
def fitted(spark):
    return _fit(spark, *_rows(spark))


def test_cases_are_purged(spark, fitted):
    rows = fitted[0].cases.collect()
    ends = {(r["series_id"], r["t_idx"]): r["t1_idx"] for r in _rows(spark)[1].collect()}
    for fold in FOLDS:
        for s in (1, 2):
            own = [r for r in rows if r["fold"] == fold["fold"] and r["series_id"] == s]
            val = [r["pos"] for r in own if r["part"] == "val"]
            fit = [r["pos"] for r in own if r["part"] == "fit"]
            assert all(fold["train_from"] <= p and ends[s, p] < fold["train_to"] for p in val + fit)
            assert all(ends[s, p] + LEARNER.embargo < min(val) for p in fit) and min(fit) >= 5
            known = sum(1 for (x, p), e in ends.items() if x == s and max(5, fold["train_from"]) <= p and e < fold["train_to"])
            assert len(val) == math.ceil(known / 4)
            assert {r["pos"] for r in own if r["part"] == "test"} == set(range(fold["test_from"], fold["test_to"]))


def test_skill_and_importance_of_a_planted_signal(spark, fitted):
    model, names = fitted
    gates = learning.skill_gate(model.cases).collect()
    assert len(gates) == 2 * len(FOLDS) and all(g["passed"] and g["auc"] > 0.7 and g["n_eff"] < g["n_val"] for g in gates)
    for g in gates:
        val = [r for r in model.cases.filter(f"part = 'val' AND series_id = {g['series_id']} AND fold = {g['fold']}").collect()]
        up, down = [r for r in val if r["y"] > 0], [r for r in val if r["y"] <= 0]
        wins = sum(a["w"] * b["w"] * (1.0 if a["p"] > b["p"] else 0.5 if a["p"] == b["p"] else 0.0) for a in up for b in down)
        assert g["auc"] == pytest.approx(wins / sum(a["w"] for a in up) / sum(b["w"] for b in down))
    importance = learning.permutation_importance(model, names, repeats=2)
    mean = {r["feature"]: r["importance"] for r in learning.mean_importance(importance).collect()}
    assert mean["good"] > 0.05 and mean["good"] > 3 * abs(mean["noise"]) and mean["late"] == pytest.approx(0.0, abs=1e-12)
    assert learning.importance_by_group(importance, learning.KEY).count() == 3 * 2 * len(FOLDS)


def test_no_future_bar_changes_a_forecast(spark, fitted):
    early = [f for f in FOLDS if f["test_to"] <= 260]
    got = lambda model: {(r["series_id"], r["fold"], r["pos"]): r["forecast"] for r in learning.forecast(model, learning.direction).filter(f"fold < {len(early)}").collect()}
    whole = got(fitted[0])
    assert whole and any(v != 0 for v in whole.values())
    assert got(_fit(spark, *_rows(spark, n=early[-1]["test_to"]), early)[0]) == pytest.approx(whole)
    assert got(_fit(spark, *_rows(spark, shift=5.0))[0]) == pytest.approx(whole)


def test_a_shut_gate_and_one_sided_labels(spark):
    bars, known = _rows(spark)
    model = _fit(spark, bars, known)[0]
    assert learning.forecast(model, learning.bet, least=1e9).filter("forecast <> 0").count() == 0
    from pyspark.sql import functions as F

    same = known.withColumn("y", F.lit(1.0))
    assert _fit(spark, bars, same)[0].cases.count() == 0  # nothing to tell apart


def test_event_positions(spark):
    rows = spark.createDataFrame([(1, i, float(i % 5 == 0), [0, 1, 1, -1, -1, 0][i % 6]) for i in range(30)], "series_id long, pos long, event double, side int")
    took = lambda **k: [r["pos"] for r in learning.event_positions(rows, **k).orderBy("pos").collect()]
    assert took() == list(range(30)) and took(stride=7) == [0, 7, 14, 21, 28]
    assert took(kind="cusum") == [0, 5, 10, 15, 20, 25] and took(kind="cusum", stride=2) == [0, 10, 20]
    assert took(kind="flip") == [i for i in range(30) if i % 6 in (1, 3)]
    with pytest.raises(ValueError):
        took(kind="other")


def test_sample_weights(spark):
    labels = spark.createDataFrame([(1, 0, 4), (1, 2, 4), (1, 6, 8)], "series_id long, t_idx long, t1_idx long")
    bars = spark.createDataFrame([(1, i, 0.1 * i) for i in range(10)], "series_id long, pos long, r double")
    got = lambda kind, **k: [r["weight"] for r in learning.sample_weights(labels, bars.select("series_id", "pos"), kind, returns=bars, **k).orderBy("t_idx").collect()]
    unique = [0.75, 0.5, 1.0]
    assert got("none") == [1.0] * 3 and got("uniqueness") == pytest.approx([u / 0.75 for u in unique])
    share = [0.1 + 0.2 + 0.15 + 0.2, 0.15 + 0.2, 0.7 + 0.8]
    mean = sum(share) / 3
    assert got("return_attribution") == pytest.approx([s / mean for s in share])
    both = [s * u for s, u in zip(share, unique, strict=True)]
    assert got("uniqueness_x_return") == pytest.approx([3 * b / sum(both) for b in both])
    aged = got("none", last=0.5)
    assert aged[0] < aged[1] < aged[2] and sum(aged) == pytest.approx(3)
    with pytest.raises(ValueError):
        got("other")


def test_drop_columns_and_steps_of_bets(spark):
    assert learning.drop_columns(["a_1", "b_1", "ab"], ["^a", "_2$"]) == ["b_1"]
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(0.5,), (0.4,), (0.9,), (0.62,)], "p double")
    sizes = [r[0] for r in p.select(learning.stepped(learning.bet(F.col("p")), 0.1)).collect()]
    assert sizes == pytest.approx([0.0, 0.0, 0.8, 0.2])
