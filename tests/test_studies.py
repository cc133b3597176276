"""Drift references, account bands, resampled statistics, metrics of one's own, sweeps and ledgers."""

import datetime as dt
import hashlib
import itertools
import json
import math
import random
import statistics

import numpy as np
import pytest
from chronosift.operators import references, resamples
from chronosift.operators.execution import Costs
from chronosift.plans import sweeps
from pyspark.sql import functions as F


def _psi(expected, actual):
    e, a = (np.maximum(np.asarray(x, float) / sum(x), 1e-4) for x in (expected, actual))
    e, a = e / e.sum(), a / a.sum()
    return float(((a - e) * np.log(a / e)).sum())


def test_reference_and_drift(spark):
    rng = np.random.default_rng(0)
    rows = [(float(v), int(f), float("nan") if i % 10 == 0 else 1.0, None if i % 3 else float(v)) for i, (v, f) in enumerate(zip(rng.standard_normal(3000).round(3), rng.integers(0, 4, 3000), strict=True))]
    train = spark.createDataFrame(rows, "wide double, flag int, same double, sparse double").repartition(6)
    known = references.reference(train, ["wide", "flag", "same", "sparse"])
    assert set(known.edges) == {"wide", "flag", "sparse"} and known.edges["flag"] == [0.5, 1.5, 2.5]
    wide = sorted(r[0] for r in rows)
    for i, e in enumerate(known.edges["wide"], 1):
        assert e in wide and abs(sum(v <= e for v in wide) - 300 * i) <= 5  # the exact quantile, but for ties
    assert sum(known.expected["wide"]) == pytest.approx(1) and references.Reference.from_json(known.to_json()) == known
    later = spark.createDataFrame([("a", v + 1.0, 0) for v, *_ in rows[:500]] + [("b", v, f) for v, f, *_ in rows] + [("c", 0.0, 1)] * 3, "kind string, wide double, flag int")
    assert known.missing(later) == ["sparse"]
    got = {(r["kind"], r["column"]): r for r in references.drift(known, later, ["kind"]).collect()}
    count = lambda col, xs: np.bincount(np.searchsorted(known.edges[col], xs, side="right"), minlength=len(known.edges[col]) + 1)
    assert got["a", "wide"]["psi"] == pytest.approx(_psi(known.expected["wide"], count("wide", [r[0] + 1 for r in rows[:500]]))) and got["a", "wide"]["level"] == "alert"
    assert got["a", "flag"]["psi"] == pytest.approx(_psi(known.expected["flag"], count("flag", [0] * 500)))
    assert got["b", "wide"]["psi"] == pytest.approx(0, abs=1e-9) and got["b", "wide"]["level"] == "ok"
    assert got["c", "wide"]["psi"] is None and got["c", "wide"]["level"] == "few"
    best = references.top(references.drift(known, later, ["kind"]), 1, ["kind"]).filter("kind = 'a'").collect()
    assert [r["column"] for r in best] == [max(("wide", "flag"), key=lambda c: got["a", c]["psi"])]
    report = {r["kind"]: r for r in references.drift_report(references.drift(known, later, ["kind"]), ["kind"]).collect()}
    assert report["a"]["alerts"] == "flag,wide" and report["b"]["n_alert"] == 0 and report["c"]["columns"] == 0
    assert references.reference(train.limit(0), ["wide"]).edges == {} and references.drift(known, spark.createDataFrame([(1,)], "other int")).count() == 0


def test_gaussian_reference(spark):
    known = references.gaussian_reference(["x"], 4)
    assert known.edges["x"] == pytest.approx([-0.6744897, 0.0, 0.6744897], abs=1e-6)
    rows = spark.createDataFrame([(statistics.NormalDist().inv_cdf((i + 0.5) / 400),) for i in range(400)], "x double")
    assert references.drift(known, rows).head()["psi"] == pytest.approx(0, abs=1e-9)


def test_band_of_an_account(spark):
    assert references.band_of(None) is None and references.band_of({"daily_mean": 0.1, "daily_std": 0.0}) is None and references.band_of({"sharpe": "x", "ann_vol": 1}) is None
    assert references.band_of({"daily_mean": 0.001, "daily_std": 0.01}) == (0.001, 0.01)
    sd = 0.16 / math.sqrt(252)
    assert references.band_of({"combined": {"sharpe": 1.0, "ann_vol": 0.16}}) == pytest.approx((0.16 / 252 - sd * sd / 2, sd))
    start = dt.datetime(2024, 1, 1, 12)  # a Monday
    rows = [(1, start + dt.timedelta(days=i), 100.0 * 0.97**i) for i in range(14)] + [(1, start, -5.0), (1, start + dt.timedelta(days=5, hours=1), 90.0), (2, start, 50.0)]
    got = [tuple(r) for r in references.account_band(spark.createDataFrame(rows, "id int, time timestamp_ntz, equity double"), ["id"], (0.0, 0.01)).orderBy("id", "day").collect()]
    days = [r[1] for r in got if r[0] == 1]
    assert all(d.weekday() < 5 for d in days) and len(days) == 11
    monday = next(r for r in got if r[1] == dt.date(2024, 1, 8))  # Saturday to Monday are one day
    assert monday[2] == 5 and monday[3] == pytest.approx(math.log(0.97**7)) and monday[5] == pytest.approx(math.log(0.97**7) / (0.01 * math.sqrt(5))) and monday[8] == "critical"
    assert got[0][2:6] == (0, 0.0, 0.0, None) and got[0][8] == "ok" and next(r for r in got if r[0] == 2)[2] == 0
    with pytest.raises(ValueError):
        references.account_band(spark.createDataFrame(rows, "id int, time timestamp_ntz, equity double"), ["id"], (0.0, 0.01), warn=-4.0)


def _drawn(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def test_bootstrap_of_any_statistic(spark):
    rng = random.Random(2)
    series = {k: [rng.gauss(0.1, 1) for _ in range(n)] for k, n in (("a", 60), ("b", 41))}
    rows = spark.createDataFrame([(k, i, x) for k, v in series.items() for i, x in enumerate(v)] + [("a", 999, None), ("b", 998, float("nan"))], "name string, t int, r double")
    want = {}
    for k, v in series.items():
        for s in range(25):
            at, out = 0, []
            for i in range(len(v)):
                at = math.floor(_drawn("7s", s, i) * len(v)) if i == 0 or _drawn("7r", s, i) < 1 / 5 else (at + 1) % len(v)
                out.append(v[at])
            want[k, s] = out
    drawn = {}
    for r in resamples.resampled(rows, ["name"], value="r", order="t", samples=25, block=5, seed=7).orderBy("i").collect():
        drawn.setdefault((r["name"], r["sample"]), []).append(r["x"])
    assert drawn == want
    spread = lambda x: float(x.max() - x.min())
    found = resamples.bootstrap(rows, ["name"], {"median": F.median}, {"spread": spread}, value="r", order="t", samples=25, block=5, seed=7)
    got = {(r["name"], r["statistic"]): r for r in found.collect()}
    for (k, stat), r in got.items():
        f = statistics.median if stat == "median" else lambda x: max(x) - min(x)
        each = [f(want[k, s]) for s in range(25)]
        assert r["n"] == len(series[k]) and r["estimate"] == pytest.approx(f(series[k])) and r["std_error"] == pytest.approx(statistics.stdev(each))
        assert (r["lower"], r["upper"]) == pytest.approx(tuple(np.quantile(each, [0.025, 0.975]))) and r["bias"] == pytest.approx(statistics.mean(each) - f(series[k]))
        assert r["prob_le_zero"] == pytest.approx(sum(x <= 0 for x in each) / 25)
    assert len(got) == 4
    basic = resamples.bootstrap(rows, ["name"], {"median": F.median}, value="r", order="t", samples=25, block=5, seed=7, basic=True).filter("name = 'a'").head()
    assert basic["lower"] == pytest.approx(2 * basic["estimate"] - got["a", "median"]["upper"])


def test_cross_validation_by_any_metric(spark):
    rng = random.Random(3)
    m = {k: [round(rng.gauss(0, 1), 2) for _ in range(24)] for k in "abcd"}
    rows = spark.createDataFrame([(k, i, x) for k, v in m.items() for i, x in enumerate(v)], "name string, date int, ret double")
    got = {r["combo"]: r for r in resamples.cscv(rows, F.max, blocks=4).collect()}
    for c, half in enumerate(itertools.combinations(range(4), 2)):
        inside = {k: max(x for i, x in enumerate(v) if i // 6 in half) for k, v in m.items()}
        outside = {k: max(x for i, x in enumerate(v) if i // 6 not in half) for k, v in m.items()}
        chosen = min(inside, key=lambda k: (-inside[k], k))
        below, same = sum(v < outside[chosen] for v in outside.values()), sum(v == outside[chosen] for v in outside.values())
        assert (got[c]["chosen"], got[c]["inside"], got[c]["outside"]) == (chosen, inside[chosen], outside[chosen]) and got[c]["w"] == pytest.approx((below + (same + 1) / 2) / 5)
    total = resamples.overfitting(resamples.cscv(rows, F.max, blocks=4)).head()
    assert total["combos"] == 6 and total["pbo"] == pytest.approx(sum(r["logit"] <= 0 for r in got.values()) / 6)
    with pytest.raises(ValueError):
        resamples.cscv(rows, F.max, blocks=3)


def _hold(rows, base):
    return rows.withColumn("position", F.col("k").cast("double"))


def test_sweep_scales_by_training_bars_alone(spark):
    start = dt.datetime(2024, 1, 1)
    price = [100 + (i * 7 % 11) for i in range(40)]
    bars = spark.createDataFrame([(s, start + dt.timedelta(hours=i), float(p), p + 1.0, p - 1.0, p + 0.5, 0.0) for s in (1, 2) for i, p in enumerate(price)], "series_id long, time timestamp_ntz, open double, high double, low double, close double, spread double")
    folds = [{"fold": 0, "train_from": 0, "train_to": 10, "test_from": 10, "test_to": 20}, {"fold": 1, "train_from": 10, "train_to": 20, "test_from": 20, "test_to": 30}]
    free = Costs(min_spread=0.0, slip_fixed=0.0, slip_range=0.0, commission=0.0)
    axes = {"k": [0, 1, -2]}
    oos = sweeps.walk_forward_points(bars, _hold, axes, folds, free)
    rows = oos.orderBy("label", "series_id", "time").collect()
    assert len(rows) == 3 * 2 * 20 and {r["label"] for r in rows} == {"k=0", "k=1", "k=-2"}
    assert {(r["k"], r["scalar"]) for r in rows} == {(0, 0.0), (1, 0.5), (-2, 0.25)}
    assert {r["position"] for r in rows if r["k"] == -2 and r["time"].day == 1 and r["time"].hour > 10} == {-0.5}
    table = {r["label"]: r for r in sweeps.sweep_table(oos, axes).collect()}
    assert table["k=1"]["n_folds"] == 2 and table["k=1"]["sr"] == pytest.approx(-table["k=-2"]["sr"]) and table["k=0"]["sr"] is None
    returns = sweeps.period_returns(oos, 1e6, "hour")
    whole = sweeps.complete_periods(returns.filter("NOT (label = 'k=1' AND date < TIMESTAMP_NTZ'2024-01-01 15:00:00')"))
    assert whole.select("date").distinct().count() == 15 and whole.count() == 45
    assert sweeps.grid_pbo(returns, 9).count() == 70 and sweeps.grid_pbo(returns.filter("label = 'k=1'")).count() == 0
    assert sweeps.grid_pbo(returns.filter("date < TIMESTAMP_NTZ'2024-01-01 15:00:00'")).count() == 2  # five hours: two blocks
    for bad in ({"k": []}, {"k": [1, 1]}, {"k": list(range(5000))}):
        with pytest.raises(ValueError):
            sweeps.with_points(bars, bad)


def test_ledgers(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entry = {"symbol": "X", "window_start": "2024-01-10T00:00:00", "window_end": "2024-03-05T00:00:00", "config_hashes": ["a", "b"]}
    sweeps.append_ledger(entry, path, spark)
    sweeps.append_ledger(entry | {"symbol": None, "config_hashes": ["b", "c"], "window_end": "2024-01-20T00:00:00"}, path, spark)
    sweeps.append_ledger(entry | {"symbol": "Y"}, path, spark)
    (tmp_path / "ledger" / "torn.txt").write_text('{"symbol": "X", "window_st\n' + json.dumps({"symbol": "X"}) + "\n")
    entries = sweeps.read_ledger(spark, path).cache()
    assert entries.count() == 5 and entries.filter("broken IS NOT NULL").count() == 1
    day = lambda *a: dt.datetime(2024, *a)
    own = spark.createDataFrame([("X", day(1, 15), day(2, 20), ["a"]), ("X", day(3, 1), day(3, 31), []), ("X", day(3, 6), day(4, 1), []), ("Y", day(2, 1), day(2, 2), None)], "symbol string, window_start timestamp_ntz, window_end timestamp_ntz, config_hashes array<string>")
    got = {(r["symbol"], r["window_start"].month, r["window_start"].day): (r["n_sweeps"], r["n_configs"]) for r in sweeps.prior_trials(entries, own).collect()}
    assert got == {("X", 1, 15): (2, 2), ("X", 3, 1): (1, 2), ("X", 3, 6): (0, 0), ("Y", 2, 1): (1, 2)}


def _earned(f, edge, cost, gamma):
    return sum(e * x - gamma / 2 * x * x - c * abs(x - y) for e, c, x, y in zip(edge, cost, f, [f[-1], *f[:-1]], strict=True))


def test_cycles_earn_as_much_as_any(spark):
    from chronosift.operators import cycles

    rng = random.Random(4)
    rows, want = [], {}
    for s in range(40):
        slots = rng.choice([1, 3, 5])
        edge, cost, gamma = [rng.gauss(0, 1) for _ in range(slots)], [abs(rng.gauss(0, 0.6)) for _ in range(slots)], rng.uniform(0.5, 2)
        rows += [(s, b, edge[b], cost[b], gamma, "x") for b in range(slots)]
        want[s] = (edge, cost, gamma, max(_earned(f, edge, cost, gamma) for f in itertools.product([-1.0, -0.5, 0.0, 0.5, 1.0], repeat=slots)))
    rows += [(99, 0, None, 0.1, 1.0, "x"), (99, 1, 1.0, None, 1.0, "x")]
    found = {}
    for r in cycles.cycle_positions(spark.createDataFrame(rows, "s int, slot int, edge double, cost double, gamma double, ring string").repartition(3), ["s"], points=5).orderBy("s", "slot").collect():
        found.setdefault(r["s"], []).append(r["position"])
        assert r["converged"]
    for s, (edge, cost, gamma, most) in want.items():
        assert _earned(found[s], edge, cost, gamma) == pytest.approx(most, abs=1e-6)
    assert found[99] == [0.5, 0.5]  # no way to move where there is something to earn, so it moves before
    with pytest.raises(ValueError):
        cycles.cycle_positions(spark.createDataFrame(rows, "s int, slot int, edge double, cost double, gamma double, ring string"), ["s"], points=4)


def test_paths_take_every_day_once(spark):
    from chronosift.operators import splits

    n, groups, k = 23, 5, 2
    combos = splits.cpcv(n, groups, k)
    rows = [(c["combo"], p, float(c["combo"] * 1000 + p)) for c in combos for a, b in c["spans"] for p in range(a, b)]
    got = splits.assemble_paths(spark.createDataFrame(rows, "split int, pos long, p double"), n, groups, k).collect()
    paths = splits.cpcv_paths(groups, k)
    edges = [i * (n // groups) + min(i, n % groups) for i in range(groups + 1)]
    want = {(i, path[g], p): path[g] * 1000.0 + p for i, path in enumerate(paths) for g in range(groups) for p in range(edges[g], edges[g + 1])}
    assert {(r["path"], r["split"], r["pos"]): r["p"] for r in got} == want and len(got) == len(want) == n * len(paths)
