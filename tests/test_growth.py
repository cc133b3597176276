"""Steps whose work must grow no faster than their rows: results against plain Python, and plans without frames that are gone through once a row."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from chronosift.functions import ewm
from chronosift.operators import references, risk, rolling, snapshots
from chronosift.operators.asof import asof_join
from chronosift.operators.intervals import counts_within
from chronosift.plans import evidence, features, market
from pyspark.sql import Window
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def _p_values(spark):
    """Ties, extremes and (first in the order) a null, over many partitions."""
    rng = random.Random(4)
    rows = [(i, rng.choice([0.0, 1.0, 0.5, rng.random(), rng.random() ** 9])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "name long, p double").repartition(5)


def test_p_values_under_dependence(spark):
    rows, df = _p_values(spark)
    out = risk.more_adjusted(df)
    assert "unboundedfollowing" not in plan(out) and out.columns == ["name", "p", "sidak", "bhy"]
    m, c, least, want = len(rows), sum(1 / k for k in range(1, len(rows) + 1)), 1.0, {}
    for k, (name, p) in reversed(list(enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1))):
        least = min(least, p * m * c / k)
        want[name] = (1 - (1 - p) ** m, least)
    got = {r["name"]: (r["sidak"], r["bhy"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], rel=1e-12) for n in want)
    for n in (1, 63, 64, 500):
        assert spark.range(1).select(risk.harmonic(F.lit(n))).head()[0] == pytest.approx(sum(1 / k for k in range(1, n + 1)), rel=1e-14)


def test_all_adjustments(spark):
    rows, df = _p_values(spark)
    out = risk.adjust_pvalues(df)
    assert "unboundedfollowing" not in plan(out) and out.columns == ["name", "p", "bonferroni", "holm", "bh"]
    m, order, want, most, least = len(rows), sorted(rows, key=lambda r: (r[1], r[0])), {}, 0.0, 1.0
    for k, (name, p) in enumerate(order, 1):
        most = max(most, p * (m - k + 1))
        want[name] = [min(p * m, 1.0), min(most, 1.0)]
    for k, (name, p) in reversed(list(enumerate(order, 1))):
        least = min(least, p * m / k)
        want[name].append(least)
    assert {r["name"]: [r["bonferroni"], r["holm"], r["bh"]] for r in out.collect()} == want


T0 = dt.datetime(2024, 1, 1)
SPANS = {"day": (0, 86_400_000_000), "next": (1, 21_600_000_001), "past": (-10_800_000_000, 1)}


def _moments(spark):
    """Moments (one without a time, two alike) and events, some at the very instant and at the ends of spans."""
    rng = random.Random(5)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    points = [(i, at(rng.randrange(400_000))) for i in range(60)] + [(60, None), (61, at(7200)), (62, at(7200)), (63, at(-500_000))]
    events = [at(rng.randrange(400_000)) for _ in range(500)] + [at(7200)] * 3 + [at(7200 + 86_400), at(7200 + 21_600), at(7200 - 10_800)]
    return points, events, spark.createDataFrame(points, "id int, time timestamp_ntz").repartition(3), spark.createDataFrame([(e,) for e in events] + [(None,)], "at timestamp_ntz").repartition(4)


def test_counts_within_spans(spark):
    points, events, p, e = _moments(spark)
    out = counts_within(p, e, SPANS, at="at")
    assert "rangeframe" not in plan(out).replace(" ", "")
    us = lambda t: (t - T0) // dt.timedelta(microseconds=1)
    want = {i: tuple(sum(lo <= us(x) - us(t) < hi for x in events) if t else 0 for lo, hi in SPANS.values()) for i, t in points}
    assert {r["id"]: (r["day"], r["next"], r["past"]) for r in out.collect()} == want and want[61][2] >= 4


def test_registered_counts_use_no_range_frame(spark, tmp_path):
    rows = [(i, 1, T0 + dt.timedelta(minutes=17 * i), "error" if i % 3 else "view", 1.0) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = market.events_in_24h(spark, str(tmp_path))
    assert "rangeframe" not in plan(out).replace(" ", "")
    errors = [t for i, _, t, kind, _ in rows if kind == "error"]
    hours = {t.replace(minute=0) for _, _, t, _, _ in rows}
    assert {r["time"]: r["n_events"] for r in out.collect()} == {h: sum(h <= t < h + dt.timedelta(days=1) for t in errors) for h in hours}


def test_forward_joins_run_from_the_end(spark):
    points, events, p, e = _moments(spark)
    for strict in (False, True):
        out = asof_join(p, e, right_time="at", columns=["at"], forward=True, strict=strict)
        assert "currentrow$(),unboundedfollowing$()" not in plan(out).replace(" ", "")
        want = {i: min((x for x in events if t and (x > t if strict else x >= t)), default=None) for i, t in points}
        assert {r["id"]: r["at"] for r in out.collect()} == want


def test_exact_quantiles_of_references(spark):
    rng = random.Random(6)
    wide, tied = [rng.random() ** 3 for _ in range(4001)], [float(rng.choice([1, 1, 1, 2, 5, *range(20, 60)])) for _ in range(4001)]
    rows = spark.createDataFrame(list(zip(wide, tied, strict=True)), "wide double, tied double").repartition(8)
    for accuracy in (20, 100_000):
        known = references.reference(rows, ["wide", "tied"], accuracy=accuracy)
        for name, xs in (("wide", sorted(wide)), ("tied", sorted(tied))):
            assert known.edges[name] == sorted({xs[-(-len(xs) * i // 10) - 1] for i in range(1, 10)})


def test_ranks_outside_their_brackets_are_not_told(spark):
    long = spark.createDataFrame([("c", float(x)) for x in range(1, 101)], "column string, value double")
    assert references._ranked(long, {"c": [10, 20, 90]}, {"c": [8.0, 30.0, 85.0, 12.0, 40.0, 90.0]}) == {("c", 0): 10.0, ("c", 2): 90.0}
    assert references._ranked(long, {"c": [10, 20, 90]}, {"c": [1.0] * 3 + [100.0] * 3}) == {("c", 0): 10.0, ("c", 1): 20.0, ("c", 2): 90.0}


def test_forecasts_of_size_zero_have_the_largest_scalar(spark, tmp_path):
    spark.createDataFrame([(1, 200.0), (2, 220.0), (3, 200.2)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["scalar"] for r in evidence.forecast_shaping(spark, str(tmp_path)).collect()}
    assert got == {1: 10.0, 2: 0.5, 3: 10.0}  # as SQL's least() skips the null of a division by 0


def test_counted_events_of_snapshots(spark):
    points, events, p, e = _moments(spark)
    bars = spark.createDataFrame([(0, T0, T0 + dt.timedelta(hours=1), 2.0, 0.1)], "series_id long, time timestamp_ntz, available_at timestamp_ntz, close double, spread double")
    for shift in (None, 7000):
        take = lambda **k: snapshots.snapshots(p.withColumnRenamed("time", "now"), snapshots.bar_statistics(bars), events=e.select(F.col("at").alias("time"), F.lit("x").alias("name")), ahead_hours=6, back_hours=3, shift=shift, **k)  # noqa: B023, E731
        out = take(listed=False)
        assert "collect_list(if" not in plan(out) and not {"upcoming", "past"} & set(out.columns)
        want = {r["id"]: (len(r["upcoming"]), len(r["past"]), r["upcoming"][0]["time"] if r["upcoming"] else None, r["past"][-1]["time"] if r["past"] else None) for r in take().collect()}
        got = {r["id"]: (r["n_upcoming"], r["n_past"], r["next_time"], r["last_time"]) for r in out.collect()}
        assert got == want and got[61][1] >= 4 and got[63] == (0, 0, None, None)


def test_trend_has_no_regressions_by_frame(spark):
    """A gap, a constant stretch longer than a window, and a drift, far from zero; two series, one shorter than a window."""
    rng = random.Random(6)
    close = [2000 + 0.1 * i + rng.random() if i < 150 or i > 230 else 2015.7 for i in range(400)]
    rows = [(s, T0 + dt.timedelta(hours=i), c if i != 60 else None) for s, n in ((0, 400), (1, 15)) for i, c in enumerate(close[:n])]
    bars = spark.createDataFrame(rows, "series_id long, time timestamp_ntz, close double").withColumns({c: F.col("close") + x for c, x in (("open", 0.0), ("high", 0.5), ("low", -0.5))})
    out = features.trend(bars)
    assert "regr" not in plan(out) and {"pos", "a", "l20"}.isdisjoint(out.columns)
    by = Window.partitionBy("series_id").orderBy("time")
    placed = out.withColumn("pos", F.row_number().over(by).cast("double"))
    for n in (20, 50, 100):
        slope, r2 = rolling.linreg(F.col("close"), F.col("pos"), n)
        a = placed.withColumns({"slope": slope, "r2": r2}).orderBy("series_id", "time").select("series_id", "slope", "r2", f"trend_lin_r2_{n}").collect()
        assert sum(r["r2"] is not None for r in a) > 150 and any(r["slope"] is not None and r["r2"] is None for r in a) == (n < 80)
        for r in a:
            assert (r["r2"] is None) == (r[f"trend_lin_r2_{n}"] is None) and r["r2"] == pytest.approx(r[f"trend_lin_r2_{n}"], abs=1e-9)
        y = pd.Series([c if i != 60 else None for i, c in enumerate(close)], dtype=float)
        for block in (7, 16_384):
            got = ewm.linreg(y, n, block)["slope"]
            assert [r["slope"] for r in a if r["series_id"] == 0] == pytest.approx([None if math.isnan(x) else x for x in got], abs=1e-9)
