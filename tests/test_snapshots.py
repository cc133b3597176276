"""Snapshots show nothing after their moment; journals with torn lines; sums of usage."""

import datetime as dt

import pytest
from chronosift.operators import snapshots
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
BARS = "series_id long, time timestamp_ntz, available_at timestamp_ntz, open double, high double, low double, close double, volume double, spread double"


def _sources(spark, after=None):
    """Bars, macro and events; of all that becomes known after a moment the values are others."""
    h = lambda n: T0 + dt.timedelta(hours=n)
    bent = lambda at, x: x * 7 + 1 if after is not None and at > after else x
    bars = [(0, h(i), h(i + 1), 1.0, 1.0, 1.0, bent(h(i + 1), 100.0 + i % 9), 1.0, 0.1) for i in range(60)]
    macro = [(n, (T0 + dt.timedelta(days=d)).date(), T0 + dt.timedelta(days=d, hours=21 + k), bent(T0 + dt.timedelta(days=d, hours=21 + k), d * 10.0 + k)) for d in range(3) for k, n in enumerate(("rates", "gold"))]
    events = [(h(5 * i + 2), f"e{i}", bent(h(5 * i + 2), i / 10)) for i in range(14)]
    return spark.createDataFrame(bars, BARS), spark.createDataFrame(macro, "name string, date date, available_at timestamp_ntz, value double"), spark.createDataFrame(events, "time timestamp_ntz, name string, surprise double")


def _taken(spark, moments, sources, **more):
    bars, macro, events = sources
    rows = spark.createDataFrame([(m, "kept") for m in moments], "now timestamp_ntz, note string")
    return snapshots.snapshots(rows, snapshots.bar_statistics(bars, means=(10,), recent=3), macro=macro, events=events, ahead_hours=12, back_hours=6, **more).orderBy("now").collect()


def test_nothing_after_the_moment_shows(spark):
    for now in (T0 + dt.timedelta(hours=30, minutes=10), T0 + dt.timedelta(hours=22)):
        assert _taken(spark, [now], _sources(spark)) == _taken(spark, [now], _sources(spark, after=now))


def test_what_a_snapshot_says(spark):
    early, now = T0 + dt.timedelta(minutes=30), T0 + dt.timedelta(hours=46)  # a bar and a publication at that very instant
    first, one = _taken(spark, [early, now], _sources(spark))
    assert first["close"] is None and first["bar_time"] is None and first["macro"] is None and [e["name"] for e in first["upcoming"]] == ["e0", "e1", "e2"] and first["past"] == []
    assert one["bar_time"] == T0 + dt.timedelta(hours=45) and one["close"] == 100.0 and one["ret_1"] == pytest.approx(100 / 108 - 1) and [b["close"] for b in one["recent"]] == [107.0, 108.0, 100.0]
    assert one["macro"] == {"rates": 10.0, "gold": 11.0} and one["note"] == "kept"
    assert [e["name"] for e in one["upcoming"]] == ["e9", "e10", "e11"] and not hasattr(one["upcoming"][0], "surprise")
    assert [(e["name"], e["surprise"]) for e in one["past"]] == [("e8", 0.8)]


def test_hidden_dates_and_prices(spark):
    now = T0 + dt.timedelta(hours=46)
    plain, hidden = (_taken(spark, [now], _sources(spark), **k)[0] for k in ({}, {"shift": 7 * 4000}))
    move = dt.timedelta(days=28_000)
    assert hidden["now"] == now + move and hidden["bar_time"] == plain["bar_time"] + move and hidden["now"].weekday() == now.weekday()
    assert hidden["close"] == 1.0 and [b["close"] for b in hidden["recent"]] == [b["close"] / plain["close"] for b in plain["recent"]]
    assert [e["time"] for e in hidden["past"]] == [e["time"] + move for e in plain["past"]] and hidden["ret_5"] == plain["ret_5"]
    with pytest.raises(ValueError):
        _taken(spark, [now], _sources(spark), shift=10)
    assert snapshots.shift_days("2024-01-01") % 7 == 0


def test_torn_journals(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"cycle_id": "a", "event": "memo", "tokens": 5}\n\n{"cycle_id": "b", "ev\n{"cycle_id": "c", "event": "decision", "status": "ok"}\n')
    rows = snapshots.read_journal(spark, str(tmp_path / "j.jsonl")).cache().collect()
    assert [(r["cycle_id"], r["event"]) for r in rows if r["broken"] is None] == [("a", "memo"), ("c", "decision")]
    assert [r["broken"] for r in rows if r["broken"] is not None] == ['{"cycle_id": "b", "ev']


def test_usage(spark):
    calls = spark.createDataFrame([("x", "m", 1_000_000, 0, None, 0, False), ("x", "new", 0, 1_000_000, 0, 0, False), ("y", "m", 100, 0, 100, 1000, False), ("y", "m", 500, 0, 0, 7, True)], "agent string, model string, input long, output long, cache_write long, cache_read long, declined boolean")
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("n", 3.0, 9.0)], snapshots.PRICED)
    got = {r["agent"]: r for r in snapshots.usage_summary(snapshots.usage_costs(calls, prices), most_cost=10.0, most_tokens=4_000_000).collect()}
    assert (got["x"]["calls"], got["x"]["tokens"], got["x"]["cost"], got["x"]["over"]) == (2, 2_000_000, 10.0, True)
    assert got["y"]["cost"] == pytest.approx((100 + 125 + 100) / 1e6) and (got["y"]["tokens"], got["y"]["unbilled"]) == (1200, 507)
    assert got[None]["calls"] == 4 and got[None]["cost"] == pytest.approx(10.0 + 325e-6)
    assert snapshots.usage_summary(snapshots.usage_costs(calls.drop("declined"), prices)).filter(F.col("used") == 0).count() == 3
