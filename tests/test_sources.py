"""Schedules, synthetic data, and rules on other inputs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronosift.plans import rules
from chronosift.sources import schedule, synthetic


def test_statements_and_payrolls(spark):
    got = schedule.statements(spark, "2012-01-01", "2012-12-31").orderBy("time").collect()
    assert [r["time"] for r in got][:3] == [dt.datetime(2012, 1, 25, 17, 30), dt.datetime(2012, 3, 13, 18, 15), dt.datetime(2012, 4, 25, 16, 30)]
    assert len(got) == 8 and all(r["approximate"] for r in got)
    assert schedule.statements(spark).count() == 128
    one = schedule.statements(spark, "2024-03-20", "2024-03-20").collect()
    assert [(r["time"], r["approximate"]) for r in one] == [(dt.datetime(2024, 3, 20, 18), False)]
    months = spark.createDataFrame([(dt.date(y, m, 1),) for y, m in ((2023, 12), (2021, 1), (2015, 7), (2016, 1), (2026, 7))], "m date")
    by = {r["m"]: (r["a"], r["b"]) for r in months.select("m", schedule.payroll_day(F.col("m")).alias("a"), schedule.payroll_day(F.col("m"), "bls").alias("b")).collect()}
    assert by[dt.date(2023, 12, 1)] == (dt.date(2023, 12, 1), dt.date(2023, 12, 8))
    assert by[dt.date(2021, 1, 1)][0] == dt.date(2021, 1, 8) and by[dt.date(2015, 7, 1)][0] == dt.date(2015, 7, 2) and by[dt.date(2026, 7, 1)][0] == dt.date(2026, 7, 2)
    with pytest.raises(ValueError):
        schedule.payroll_day(F.col("m"), "other")


def test_calendar_and_importance(spark):
    c = schedule.calendar(spark, "2024-01-01", "2024-03-20").orderBy("time").collect()
    assert [(r["name"], r["time"].date()) for r in c] == [("NFP", dt.date(2024, 1, 5)), ("FOMC", dt.date(2024, 1, 31)), ("NFP", dt.date(2024, 2, 2)), ("NFP", dt.date(2024, 3, 1)), ("FOMC", dt.date(2024, 3, 20))]
    assert schedule.calendar(spark, "2024-01-01", "2024-03-20", include=()).count() == 0
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1, 0.5), (dt.datetime(2024, 1, 2), None, 0.1), (dt.datetime(2024, 1, 3), 3, 0.2)], "time timestamp_ntz, importance long, actual double")
    kept = schedule.important(rows)
    assert kept.columns == ["time", "importance"] and [r["importance"] for r in kept.collect()] == [None, 3]


@pytest.mark.parametrize("model", synthetic.MODELS)
def test_models_of_bars(spark, model):
    p = synthetic.make_bars(spark, 1500, seed=2, model=model).orderBy("time").toPandas()
    assert (p["high"] >= p[["open", "close"]].max(axis=1)).all() and (p["low"] <= p[["open", "close"]].min(axis=1)).all() and p["time"].is_unique
    r = np.log(p["close"]).diff().dropna()
    if model == "trend":
        assert r.autocorr() > 0.03
    if model == "mean_revert":
        assert abs(np.log(p["close"] / 1800)).max() < 0.1
    if model == "jump":
        assert r.kurt() > 1
    if model == "regime":
        assert r.rolling(100).std().max() > 2 * r.rolling(100).std().min()
    with pytest.raises(ValueError):
        synthetic.make_bars(spark, 10, model="none")


def test_macro_and_events(spark):
    bars = synthetic.make_bars(spark, 2000, seed=4)
    m = synthetic.make_macro(bars, seed=1)
    days = {r["name"]: r["n"] for r in m.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(days) == {"dxy", "spx", "vix", "us10y", "real10y"} and len(set(days.values())) == 1
    assert m.filter("available_at <> CAST(date AS TIMESTAMP_NTZ) + INTERVAL '21:30' HOUR TO MINUTE OR weekday(date) > 4").count() == 0
    assert {r["name"] for r in synthetic.make_events(spark, "2024-01-01", "2024-03-31").collect()} == {"NFP", "FOMC", "CPI"}


def _vix(spark, n=200):
    v = [18.0 + (i % 5) * 0.2 for i in range(n)]
    v[120:125], v[125] = [40.0, 42.0, 38.0, 30.0, 26.0], 19.0
    return spark.createDataFrame([(0, dt.date(2020, 1, 6) + dt.timedelta(days=i), dt.datetime(2020, 1, 6, 21, 30) + dt.timedelta(days=i), float(x)) for i, x in enumerate(v)], "series_id long, date date, available_at timestamp_ntz, value double"), v


def test_risk_off(spark):
    vix, v = _vix(spark)
    got = rules.fear(vix).orderBy("date").toPandas()
    x = pd.Series(np.log(v))
    e = x.ewm(halflife=60, adjust=True, min_periods=40)
    z, on = (x - e.mean().shift(1)) / e.std().shift(1), False
    for i in range(len(v)):
        on = z[i] > 1.5 or (on and z[i] >= 0.5)
        want = min(max(0.5 * (z[i] - 0.5), 0), 1) if on else 0.0
        assert abs(got["fear"][i] - want) < 1e-9
    assert got["fear"].iloc[120] == 1.0 and got["fear"].iloc[100] == 0.0
    bars = synthetic.make_bars(spark, 4000, start="2020-01-06")
    out = rules.risk_off(bars, vix).filter("risk_off > 0").agg(F.min("available_at"), F.max("available_at")).head()
    # known from that evening on, and old by ten days after the last value
    assert out[0] >= dt.datetime(2020, 5, 5, 21, 30) and out[1] < dt.datetime(2020, 5, 16)
    squeeze = vix.withColumn("value", F.when(F.col("date") >= F.lit("2020-05-01").cast("date"), 130.0).otherwise(100.0 + F.dayofyear("date") % 2 * 0.1))
    assert rules.risk_off(bars, vix, squeeze).filter("risk_off > 0 AND available_at < TIMESTAMP_NTZ '2020-05-06 00:00:00'").count() == 0


def test_regime_meta_and_ml(spark):
    bars = synthetic.make_bars(spark, 700, seed=6, model="regime")
    cut = str(sorted(r[0] for r in bars.select("time").collect())[400])
    both = rules.regime_switch(bars, "donchian", cut).join(rules.donchian(bars).select("series_id", "time", "donchian"), ["series_id", "time"]).toPandas()
    assert (both["regime_switch"].abs() <= both["donchian"].abs() + 1e-12).all() and (both["regime_switch"] * both["donchian"] >= 0).all()
    rows = spark.createDataFrame([(1.0, 0.9), (-1.0, 0.9), (1.0, 0.3), (None, 0.9), (1.0, None)], "side double, p double")
    m = [r["meta_label"] for r in rules.meta_label(rows, "side", "p").collect()]
    assert m[0] > 0.7 and m[1] == -m[0] and m[2:] == [0.0, 0.0, 0.0]
    f = [r["ml_gbm"] for r in rules.ml_forecast(rows, "p", dead=0.2).collect()]
    assert abs(f[0] - (0.8 - 0.2) / 0.8) < 1e-12 and abs(f[2] + (0.4 - 0.2) / 0.8) < 1e-12 and f[4] == 0.0
    assert rules.skill(0.5, 100, 100) == 0 and rules.skill(0.7, 200, 200) > 3 > rules.skill(0.7, 200, 200, 0.1) > 0
