"""Regimes in several dimensions: likelihoods rise, restarts win, planted states are found, the past alone decides."""

import datetime as dt

import numpy as np
import pytest
from chronosift.plans import regimes

T0 = dt.datetime(2024, 1, 1)


def _planted(seed, steps=400, hard=False):
    rng = np.random.default_rng(seed)
    state, out, states = 0, [], []
    for _ in range(steps):
        state = state if rng.random() < 0.95 else 1 - state
        out.append(rng.normal([0.0, 2.0 * state], [0.5 + 2.5 * state, 1.0] if not hard else [1.0, 1.0]))
        states.append(state)
    return np.array(out), np.array(states)


def test_likelihood_never_falls_and_restarts_win():
    x = np.stack([_planted(s, 200, hard=s % 2 == 1)[0] for s in range(6)])
    x[0, 5:9] = np.nan
    x[1, 3, 1] = np.nan
    history = []
    many = regimes.fit(x, 2, 5, 25, history=history)
    steps = np.diff(np.stack(history), axis=0)
    assert (steps > -1e-6).all()
    one = regimes.fit(x, 2, 0, 25)
    assert (many.score >= one.score - 1e-6).all() and np.allclose(np.exp(many.move).sum(axis=2), 1) and (np.diff(many.var[:, :, 0], axis=1) >= 0).all()


def test_forward_equals_all_paths():
    import itertools

    x = _planted(3, 6)[0][None]
    m = regimes.fit(x, 2, 1, 3)
    d = regimes.densities(x, m)[0]
    paths = [m.start[0][p[0]] + sum(d[t, s] for t, s in enumerate(p)) + sum(m.move[0][a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(2), repeat=6)]
    assert regimes.forward(regimes.densities(x, m), m)[1][0] == pytest.approx(np.log(np.exp(paths).sum()))
    gamma = regimes.expectation(x, m)[0][0]
    for t in range(6):
        one = np.log(np.exp([v for v, p in zip(paths, itertools.product(range(2), repeat=6), strict=True) if p[t] == 1]).sum())
        assert gamma[t, 1] == pytest.approx(np.exp(one - np.log(np.exp(paths).sum())))


def test_planted_regimes_by_series(spark):
    rows, truth = [], {}
    for s in range(5):
        x, states = _planted(10 + s, 300 + 20 * s)
        rows += [(s, T0 + dt.timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(x)]
        truth[s] = states
    rows += [(9, T0 + dt.timedelta(hours=i), 1.0, None) for i in range(20)]
    df = spark.createDataFrame(rows, "series_id long, time timestamp_ntz, a double, b double").repartition(3)
    cut = T0 + dt.timedelta(hours=250)
    got = {}
    for r in regimes.regime_probabilities(df, ["a", "b"], str(cut)).orderBy("time").collect():
        got.setdefault(r["series_id"], []).append(r)
    assert all(r["p"] is None and r["state"] is None and r["score"] is None for r in got[9]) and len(got[9]) == 20
    for s, states in truth.items():
        assert np.mean([r["state"] for r in got[s]] == states) > 0.9 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in got[s])
    # later rows change nothing before them
    bent = df.selectExpr("series_id", "time", f"IF(time > TIMESTAMP_NTZ'{cut + dt.timedelta(hours=10)}', a * 9 + 5, a) AS a", "b")
    again = {(r["series_id"], r["time"]): r["p"] for r in regimes.regime_probabilities(bent, ["a", "b"], str(cut)).filter(f"time <= TIMESTAMP_NTZ'{cut}'").collect()}
    assert all(again[r["series_id"], r["time"]] == pytest.approx(r["p"]) for s in truth for r in got[s] if r["time"] <= cut)
