"""Look-backs and snapshots: the newest rows from few bars equal those of a run over all."""

import datetime as dt
import math
import random

import pytest
from chronosift.plans import warmup
from chronosift.plans.features import GROUPS, Pipeline

PARAMS = {"returns": {"horizons": [1, 3], "halflife": 3}, "trend": {"spans": [5], "windows": [12], "atr_n": 3}, "meanrev": {"windows": [10, 30]}, "range": {"windows": [15], "atr_n": 4}, "microstructure": {"z_window": 40, "autocorr": 20}, "regime": {"vol_window": 10, "rank": 60, "least": 20}}
GROUP_NAMES = [*PARAMS, "session"]


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(6)
    rows = []
    for s in (1, 2):
        price, at = 100.0, dt.datetime(2024, 1, 1)
        for i in range(900):
            open_ = price
            price *= math.exp(rng.gauss(0, 0.01))
            high, low = max(open_, price) * (1 + abs(rng.gauss(0, 0.002))), min(open_, price) * (1 - abs(rng.gauss(0, 0.002)))
            rows.append((s, at, open_, high, low, price, float(rng.randrange(1, 50)), 0.1 + rng.random() / 10, at + dt.timedelta(hours=1)))
            at += dt.timedelta(hours=1)
    return spark.createDataFrame(rows, "series_id long, time timestamp_ntz, open double, high double, low double, close double, volume double, spread double, available_at timestamp_ntz").repartition(4).cache()


def test_newest_rows_equal_the_whole_run(bars):
    pipe = Pipeline(GROUP_NAMES, PARAMS)
    back = warmup.max_lookback(pipe)
    assert 400 < back < 600 and back == max(warmup.group_lookback(pipe, g) for g in GROUP_NAMES)
    pipe.fit(pipe.compute(bars).filter("time < TIMESTAMP_NTZ'2024-01-25'"))
    again = warmup.from_json(warmup.to_json(pipe))
    for scaled in (False, True):
        whole = pipe.compute(bars)
        whole = warmup.newest(pipe.transform(whole) if scaled else whole, 2)
        want = {(r["series_id"], r["time"]): r.asDict() for r in whole.collect()}
        got = {(r["series_id"], r["time"]): r.asDict() for r in warmup.snapshot(again, bars, 2, scaled=scaled).collect()}
        assert got.keys() == want.keys() and len(got) == 4
        for k, row in want.items():
            for c, v in row.items():
                assert got[k][c] == (pytest.approx(v, rel=1e-8, abs=1e-10) if isinstance(v, float) else v), c


def test_lookbacks_follow_parameters(spark):
    assert set(warmup._BACK) == set(GROUPS)
    some = lambda g, **p: warmup.group_lookback(Pipeline([g], {g: p}), g)
    assert some("meanrev", windows=[500]) == 500 and some("returns", halflife=1, horizons=[200]) == 201 and some("session") == 1
    assert some("mtf") > some("returns", halflife=20, horizons=[1]) and warmup.max_lookback(Pipeline([])) == 1
    assert 0.5**40 * 0.9 < (1 - 2 / 21) ** warmup.span_tail(20) <= 0.5**40 and (1 - 1 / 14) ** warmup.wilder_tail(14) <= 0.5**40
    with pytest.raises(ValueError):
        some("meanrev", window=[3])


def test_pipelines_are_kept_as_text(spark):
    pipe = Pipeline(["meanrev", "session"], {"meanrev": {"windows": [7]}})
    pipe.stats = {"meanrev_z_7": (0.1, 1 / 3), "session_asia": (0.0, 1.0)}
    again = warmup.from_json(warmup.to_json(pipe))
    assert (again.groups, again.stats, again.limit) == (pipe.groups, pipe.stats, pipe.limit) and again.params["meanrev"]["windows"] == [7]
    assert {r["column"]: (r["location"], r["scale"]) for r in warmup.stats_table(again, spark).collect()} == pipe.stats
