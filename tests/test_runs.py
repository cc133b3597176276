"""Stored runs, the live loop, data sets, monitors and the command line."""

import datetime as dt
import json
import lzma
import struct

import pytest
from pyspark.sql import functions as F

from chronosift import cli
from chronosift.plans import runs
from chronosift.sources import dataset
from chronosift.sources import macro as macros
from chronosift.sources.synthetic import make_bars
from chronosift.streaming import live, monitors

CONFIG = runs.RunConfig(rules=("donchian", "zscore_fade"), train=150, test=60)


@pytest.fixture(scope="module")
def bars(spark):
    return make_bars(spark, 420, seed=9).cache()


@pytest.fixture(scope="module")
def stored(spark, bars, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    days = sorted(r[0] for r in bars.select("time").collect())
    config = runs.RunConfig(rules=CONFIG.rules, train=150, test=60, holdout=str(days[360]))
    return out, runs.run_walk_forward(bars, config, out), config, days


def test_a_run_and_what_it_says(spark, stored):
    out, said, config, days = stored
    run = runs.load_run(spark, out)
    folds = {r["fold"]: r for r in run["folds"].collect()}
    # purged by the longest horizon and an embargo; the holdout is a fold of its own behind all of research
    assert all(f["test_from"] - f["train_to"] >= 1 + config.embargo for f in folds.values()) and folds[-1]["test_from"] == 360 and max(f["test_to"] for k, f in folds.items() if k >= 0) <= 360
    w = {}
    for r in run["weights"].collect():
        w.setdefault(r["fold"], []).append(r["weight"])
    assert set(w) == set(folds) and all(abs(sum(x) - 1) < 1e-9 and max(x) <= 0.6 + 1e-9 for x in w.values())
    book = run["book"].orderBy("time").toPandas()
    assert len(book) == sum(f["test_to"] - f["test_from"] for f in folds.values()) and book["time"].is_unique
    assert abs(book["equity"].iloc[-1] - 100_000 - book["pnl"].sum()) < 1e-6
    assert abs(run["trades"].agg(F.sum("pnl")).head()[0] - book["pnl"].sum()) < 1e-6
    assert run["metrics"].count() == 1 and said["folds"] == len(folds) and runs.summary(spark, out)["config_hash"] == config.hash()
    parts = runs.contributions(spark, out).groupBy("time").agg(F.sum("contribution").alias("c"))
    both = run["book"].join(parts, "time").select(F.max(F.abs(F.col("combined") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c")))))).head()[0]
    assert both < 1e-12
    one = runs.explain(spark, out, str(days[300])).collect()
    assert [r["time"] for r in one] == [days[300]] * 2 and abs(sum(r["share"] or 0 for r in one) - 1) < 1e-9 or not any(r["contribution"] for r in one)
    assert abs(sum(r["pnl"] for r in runs.attribution(spark, out).collect()) - book["pnl"].sum()) < 1e-6
    tables = runs.stress_run(spark, out, paths=40, horizon=20)
    assert tables["figures"].count() == 40 and {r["threshold"] for r in tables["ruin"].collect()} == {0.5, 0.8} and tables["fan"].count() == 20
    page = runs.tearsheet(spark, out)
    assert page.count("<table>") == 4 and "sharpe" in page
    assert runs.bar_weights(spark, out).count() == 2 * len(book)


def test_later_bars_do_not_change_earlier_folds(spark, bars, stored, tmp_path):
    out, _, config, days = stored
    short = runs.RunConfig(rules=config.rules, train=150, test=60, end=str(days[330]))
    runs.run_walk_forward(bars, short, str(tmp_path))
    a = runs.load_run(spark, out)["weights"].filter("fold = 0").orderBy("strategy").collect()
    assert a == runs.load_run(spark, str(tmp_path))["weights"].filter("fold = 0").orderBy("strategy").collect()


def test_single_split_and_final_fit(spark, bars, tmp_path):
    days = sorted(r[0] for r in bars.select("time").collect())
    runs.run_single(bars, CONFIG, str(days[200]), str(tmp_path))
    book = runs.load_run(spark, str(tmp_path))["book"]
    assert book.agg(F.min("time")).head()[0] == days[200] and book.count() == 220
    assert {r["strategy"] for r in runs.fit_book(bars, CONFIG).collect()} == set(CONFIG.rules)
    with pytest.raises(ValueError):
        runs.run_single(bars, CONFIG, str(days[0]), str(tmp_path))
    with pytest.raises(ValueError):
        runs.load_config('{"rules": ["no such rule"]}')


def test_ledger_of_looks(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    runs.record_look(spark, path, CONFIG, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "now")
    runs.record_look(spark, path, runs.RunConfig(), "2024-01-15 00:00:00", "2024-03-01 00:00:00", "later")
    spark.createDataFrame([("{torn",)], "value string").coalesce(1).write.mode("append").text(path)
    from chronosift.operators.compare import prior_looks

    ledger = runs.read_ledger(spark, path)
    assert ledger.count() == 2 and prior_looks(ledger, start="2024-01-20", end="2024-01-21", config_hash=CONFIG.hash()).count() == 1


def test_live_loop_is_the_batch_book(spark, bars, tmp_path):
    rows = bars.orderBy("time").limit(200).collect()
    weights = (("donchian", 0.4), ("zscore_fade", 0.6))
    own = live.Live(f"{tmp_path}/state", CONFIG, weights, max_age="10000 days")
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], bars.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.run(spark.readStream.schema(live.BARS).parquet(f"{tmp_path}/in"), own)
    want = live.decide(spark.createDataFrame(rows, bars.schema), own).orderBy("time").toPandas()
    got = live.account(spark, own).orderBy("time").toPandas()
    assert len(got) == 200 and abs(got["equity"] - want["equity"]).max() < 1e-6 and (got["position"] == want["position"]).all()
    # a batch that is replayed changes nothing
    again = spark.createDataFrame(rows[150:], bars.schema)
    live.step(again, 3, own)
    assert live.account(spark, own).count() == 200 and live.status(spark, own)["bars"] == 200
    made = spark.read.parquet(f"{own.path}/decisions")
    orders = live.reconcile(made, spark.createDataFrame([(0, 0.5)], "series_id long, lots double")).head()
    assert abs(orders["order"] - (int(abs(orders["approved"] - 0.5) / 0.01 + 1e-9) * 0.01 * (1 if orders["approved"] > 0.5 else -1))) < 1e-9


def test_a_halt_holds_until_reset(spark, bars, tmp_path):
    rows = bars.orderBy("time").limit(120).collect()
    own = live.Live(f"{tmp_path}/state", CONFIG, (("donchian", 0.4), ("zscore_fade", 0.6)), max_drawdown=1e-9)
    live.step(spark.createDataFrame(rows[:100], bars.schema), 0, own)
    assert live.halted(spark, own)
    live.step(spark.createDataFrame(rows[100:], bars.schema), 1, own)
    assert live.status(spark, own)["bars"] == 100
    live.reset_halt(spark, own, "looked at")
    assert not live.halted(spark, own)


def test_stream_static_join(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    static = spark.createDataFrame([("a", t0, 1.0), ("a", t0 + dt.timedelta(hours=30), 2.0), ("b", t0 + dt.timedelta(days=50), 9.0)], "k string, available_at timestamp_ntz, v double")
    rows = [(k, t0 + dt.timedelta(hours=h)) for k in "ab" for h in (-1, 0, 29, 30, 100, 800)]
    spark.createDataFrame(rows, "k string, time timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, time timestamp_ntz").parquet(f"{tmp_path}/in")
    out = []
    from chronosift.streaming.bars import run_available

    run_available(monitors.with_static(stream, static, "k", columns=["v"]), lambda b, i: out.extend(b.collect()), f"{tmp_path}/ck")
    got = {(r["k"], int((r["time"] - t0).total_seconds() // 3600)): r["v"] for r in out}
    assert got == {("a", -1): None, ("a", 0): 1.0, ("a", 29): 1.0, ("a", 30): 2.0, ("a", 100): 2.0, ("a", 800): None} | {("b", h): None for h in (-1, 0, 29, 30, 100, 800)}


def test_sessions_of_a_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m), float(m)) for m in (0, 5, 40, 41, 300)]
    spark.createDataFrame(rows, "series_id long, time timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = []
    from chronosift.streaming.bars import run_available

    run_available(monitors.sessions(spark.readStream.schema("series_id long, time timestamp, price double").parquet(f"{tmp_path}/in"), "10 minutes", delay="0 seconds"), lambda b, i: out.extend(b.collect()), f"{tmp_path}/ck")
    assert sorted((r["n"], r["mean"]) for r in out)[:2] == [(2, 2.5), (2, 40.5)]


def test_quotes_positions_and_heartbeats(spark, bars):
    first = bars.orderBy("time").head()
    times = spark.createDataFrame([(first["time"],), (first["time"] + dt.timedelta(minutes=59),), (first["time"] - dt.timedelta(minutes=1),)], "time timestamp_ntz")
    got = {r["time"]: r["bid"] for r in monitors.quotes(bars, times).collect()}
    assert sorted(got.values(), key=str) == sorted([first["open"] - first["spread"] / 2] * 2 + [None], key=str)
    legs = spark.createDataFrame([(1, 0.3, "buy"), (1, 0.1, "sell"), (2, 0.2, "sell")], "series_id long, lots double, side string")
    assert {r["series_id"]: r["lots"] for r in monitors.net_lots(legs).collect()} == {1: 0.2, 2: -0.2}
    beats = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0),)], "time timestamp_ntz")
    assert [monitors.heartbeat(beats, n, 60).head()["stale"] for n in ("2024-01-01 00:03:00", "2024-01-01 00:04:00")] == [False, True]
    assert monitors.heartbeat(beats.filter("false"), "2024-01-01", 60).head()["stale"]


def test_data_set_from_candles(spark, tmp_path):
    for side, shift in (("bid", 0), ("ask", 4)):
        (tmp_path / side).mkdir()
        for d in (2, 3):
            body = b"".join(struct.pack(">IIIIIf", 60 * i, 1000 + i % 50 + shift, 1001 + i % 50 + shift, 999 + i % 50 + shift, 1002 + i % 50 + shift, 5.0) for i in range(1440))
            (tmp_path / side / f"2024-01-0{d}.bi5").write_bytes(lzma.compress(body))
    m = dataset.build(spark, str(tmp_path / "bid"), str(tmp_path / "ask"), str(tmp_path / "out"), scale=10.0)
    assert m["M1"]["rows"] == 2880 and m["H1"]["rows"] == 48 and m["M15"]["rows"] == 192 and m["D1"]["rows"] == 2
    assert json.loads(spark.read.text(str(tmp_path / "out" / "manifest")).head()[0])["H1"]["content_hash"] == m["H1"]["content_hash"]
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 4, 5, 8, 9)], "date date")
    assert dataset.cached_since(days, "2024-01-09").head()["since"] == dt.date(2024, 1, 4)
    assert dataset.cached_since(days, "2024-01-10").head()["since"] is None


def test_frames_and_json_lines(spark, bars, tmp_path):
    meta = dataset.save_frame(bars, f"{tmp_path}/f", {"source": "test"})
    df, read = dataset.load_frame(spark, f"{tmp_path}/f")
    assert read == meta and df.count() == 420 and meta["source"] == "test"
    bars.limit(10).write.mode("overwrite").parquet(f"{tmp_path}/f")
    with pytest.raises(ValueError):
        dataset.load_frame(spark, f"{tmp_path}/f")
    dataset.append_json(spark, {"a": 1}, f"{tmp_path}/j")
    dataset.append_json(spark, {"a": 2}, f"{tmp_path}/j")
    spark.createDataFrame([('{"a": 3',)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/j")
    assert sorted(r["a"] for r in dataset.read_json(spark, f"{tmp_path}/j", "a long").collect()) == [1, 2]


def test_business_day_lags(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2024, 1, 12), 1.0), (dt.date(2024, 1, 13), 2.0), (dt.date(2024, 1, 16), 3.0)], "date date, value double")
    got = {r["date"]: r["available_at"] for r in macros.lagged(rows, 1).collect()}
    # the 15th is a holiday; the 13th, a Saturday, counts as the Friday before
    assert got == {dt.date(2024, 1, 12): dt.datetime(2024, 1, 16, 21, 30), dt.date(2024, 1, 13): dt.datetime(2024, 1, 16, 21, 30), dt.date(2024, 1, 16): dt.datetime(2024, 1, 17, 21, 30)}
    named = rows.select(F.lit("x").alias("name"), "date", "value", F.col("date").cast("timestamp_ntz").alias("available_at"))
    macros.save_macro(named, f"{tmp_path}/m")
    assert macros.load_macro(spark, f"{tmp_path}/m").count() == 3 and macros.published(named, "2024-01-13 00:00:00").count() == 2


def test_command_line(spark, bars, tmp_path, capsys):
    from chronosift.sources.bars import save_bars

    save_bars(bars, f"{tmp_path}/bars")
    (tmp_path / "c.json").write_text('{"rules": ["donchian", "zscore_fade"], "train": 150, "test": 60}')
    run = lambda *a: cli.main(list(a))
    assert run("config", "--config", f"{tmp_path}/c.json") == 0 and json.loads(capsys.readouterr().out)["train"] == 150
    assert run("rules") == 0 and "donchian" in capsys.readouterr().out
    assert run("walkforward", f"{tmp_path}/bars", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json") == 0
    for args in (("report", f"{tmp_path}/out"), ("attribution", f"{tmp_path}/out"), ("explain", f"{tmp_path}/out", "2030-01-01"), ("tearsheet", f"{tmp_path}/out", f"{tmp_path}/page.html"), ("info", f"{tmp_path}/bars")):
        assert run(*args) == 0
    assert run("train-final", f"{tmp_path}/bars", f"{tmp_path}/w", "--config", f"{tmp_path}/c.json") == 0
    capsys.readouterr()
    assert run("live-status", f"{tmp_path}/w", f"{tmp_path}/state", "--config", f"{tmp_path}/c.json") == 0
    assert json.loads(capsys.readouterr().out)["bars"] == 0
    assert run("run", "no_such_query", "x", "y") == 2
