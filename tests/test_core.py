import datetime as dt
import lzma
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronosift import catalogue
from chronosift.functions import ewm, statistics
from chronosift.functions.scalars import lot_grid, normal_cdf, normal_quantile, safe_div
from chronosift.operators import execution, islands, labels, risk, rolling, splits
from chronosift.operators.asof import asof_join
from chronosift.operators.intervals import within
from chronosift.operators.resample import resample_bars
from chronosift.plans import features, rules
from chronosift.sources import bars as B
from chronosift.sources import candles, macro, synthetic

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    synthetic.make_bars(spark, 260, series=2, seed=3, jump=0.02).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_asof_rows_not_values(spark):
    left = spark.createDataFrame([(1, hours(0)), (2, hours(1)), (3, hours(5)), (4, None), (5, hours(30)), (5, hours(30))], "id int, time timestamp_ntz")
    right = spark.createDataFrame([(hours(1), 1.0, 1), (hours(1), 2.0, 2), (hours(4), None, 3), (None, 9.0, 4)], "available_at timestamp_ntz, v double, k int")
    for slices in (None, "6 hours"):
        got = sorted((r["id"], r["v"], r["k"]) for r in asof_join(left, right, columns=["v", "k"], seq="k", slices=slices).collect())
        assert [g for g in got if g[0] != 4 and g[2] is not None] == [(2, 2.0, 2), (3, None, 3), (5, None, 3), (5, None, 3)]
        assert (1, None, None) in got and (4, None, None) in got
    near = asof_join(left, right, columns=["k"], seq="k", tolerance="1 hour").filter("k IS NOT NULL").count()
    assert near == 2
    assert asof_join(left, right.limit(0), columns=["v"]).count() == 6


def test_asof_forward_and_strict(spark):
    left = spark.createDataFrame([(hours(1),), (hours(2),)], "time timestamp_ntz")
    right = spark.createDataFrame([(hours(1), "a"), (hours(2), "b"), (hours(3), "c")], "at timestamp_ntz, v string")
    get = lambda **k: [r["v"] for r in asof_join(left, right, right_time="at", columns=["v"], **k).orderBy("time").collect()]
    assert get() == ["a", "b"] and get(strict=True) == [None, "a"] and get(forward=True) == ["a", "b"] and get(forward=True, strict=True) == ["b", "c"]


def test_within(spark):
    p = spark.createDataFrame([(hours(i),) for i in range(100)], "time timestamp_ntz")
    s = spark.createDataFrame([(hours(3), hours(5)), (hours(50), hours(90)), (hours(4), hours(6))], "start timestamp_ntz, stop timestamp_ntz")
    assert within(p, s).count() == 4 + 41
    assert within(p, s, how="left_anti").count() == 100 - 45


def test_resample_completeness(spark):
    base = B.make_bars(spark.createDataFrame([(hours(i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i) for i in range(1, 11)], "time timestamp_ntz, open double, high double, low double, close double"), "1 hour", default_spread=0.1)
    got = resample_bars(base, "4 hours").collect()
    assert [(r["time"], r["open"], r["high"], r["low"], r["close"]) for r in got] == [(hours(4), 5.0, 9.0, 4.5, 8.5)]
    assert resample_bars(base, "4 hours", keep_incomplete=True).count() == 3


def test_ewm_is_causal_and_matches_its_recursion():
    x = pd.DataFrame({"close": np.exp(np.cumsum(np.random.default_rng(0).normal(0, 0.01, 200)))})
    x["high"], x["low"] = x["close"] * 1.01, x["close"] * 0.99
    y, a = ewm.ema(x["close"], 10, 1), 2 / 11
    want = x["close"].iloc[0]
    for i in range(1, 200):
        want = (1 - a) * want + a * x["close"].iloc[i]
    assert abs(y.iloc[-1] - want) < 1e-12
    assert (ewm.rsi(pd.DataFrame({"close": [1.0] * 20}), 5).dropna() == 50).all()


@pytest.mark.parametrize("group", ["returns", "meanrev", "range", "microstructure", "regime", "mtf"])
def test_features_do_not_look_ahead(spark, bars, group):
    one = bars.filter("series_id = 0")
    new = [c for c in features.GROUPS[group](one).columns if c not in one.columns]
    cut = str(sorted(r[0] for r in one.select("time").collect())[150])
    assert features.leakage(features.GROUPS[group], one, cut, new) == 0


def test_leaky_feature_is_caught(spark, bars):
    leaky = lambda b: b.withColumn("x", F.lead("close").over(rolling.series()))
    cut = str(sorted(r[0] for r in bars.filter("series_id = 0").select("time").collect())[150])
    assert features.leakage(leaky, bars.filter("series_id = 0"), cut, ["x"]) == 1


def test_pipeline_scales_on_train_only(spark, bars):
    pipe = features.Pipeline(["meanrev", "session"])
    raw = pipe.compute(bars)
    out = pipe.fit(raw).transform(raw)
    assert out.count() == 520
    assert out.agg(*[F.max(F.abs(c)) for c in out.columns[2:]]).toPandas().max(axis=1).iloc[0] <= 5.0
    constant = features.Pipeline([]).fit(bars.select("series_id", "time", F.lit(1.0).alias("k")))
    assert constant.stats == {}


def test_rules_stay_in_range(spark, bars):
    rows = bars
    for f in rules.RULES.values():
        rows = f(rows)
    got = rules.combine(rows, dict.fromkeys(rules.RULES, 0.125), 2.0).toPandas()
    assert len(got) == 520
    for name in [*rules.RULES, "combined"]:
        assert got[name].fillna(0).abs().max() <= 1.0 + 1e-12, name


def test_triple_barrier_cases(spark):
    def one(rows):
        df = B.make_bars(spark.createDataFrame([(hours(i), *map(float, r)) for i, r in enumerate(rows)], "time timestamp_ntz, open double, high double, low double, close double"), "1 hour", default_spread=0.0)
        return labels.triple_barrier(df.withColumn("t", F.lit(0.1)), target="t", pt_mult=1, sl_mult=1, horizon=2).filter("t_idx = 0").head()

    flat = (100, 100, 100, 100)
    assert one([flat, (100, 120, 99, 115), flat])["barrier_hit"] == "pt"
    assert one([flat, (100, 101, 80, 90), flat])["barrier_hit"] == "sl"
    assert one([flat, (100, 120, 80, 90), flat])["barrier_hit"] == "ambiguous"
    assert one([flat, (120, 121, 80, 90), flat])["barrier_hit"] == "pt"
    r = one([flat, flat, (100, 101, 99, 101)])
    assert r["barrier_hit"] == "vertical" and r["label"] == 1.0 and r["t1_idx"] == 2
    assert one([flat, flat])["barrier_hit"] == "incomplete"


def test_native_and_stateful_costs(spark):
    rows = [(hours(0), 10, 10, 10, 10), (hours(1), 11, 12, 11, 12), (hours(2), 12, 13, 12, 13)]
    df = B.make_bars(spark.createDataFrame([(t, *map(float, r)) for t, *r in rows], "time timestamp_ntz, open double, high double, low double, close double"), "1 hour", default_spread=0.2)
    got = execution.target_lots_pnl(df.withColumn("lots", F.lit(1.0)), "lots", execution.Costs()).orderBy("time").collect()
    assert [r["position"] for r in got] == [0.0, 1.0, 1.0]
    assert [round(r["pnl"], 9) for r in got] == [0.0, 100 - 13.5, 100.0]


def test_protective_exits():
    x = execution.intrabar_exit
    assert x(1, 100, 105, 95, 96, 104) == ("stop", 96)
    assert x(1, 94, 105, 90, 96, 104) == ("stop", 94)
    assert x(1, 106, 107, 90, 96, 104) == ("target", 106)
    assert x(-1, 100, 105, 95, 104, 96) == ("stop", 104)
    assert x(0, 100, 105, 95, 96, 104) == (None, None)


def test_simulated_kill_switch(spark):
    rows = [(hours(i), 100.0 - 3 * i, 100.0 - 3 * i, 97.0 - 3 * i, 97.0 - 3 * i) for i in range(25)]
    df = B.make_bars(spark.createDataFrame(rows, "time timestamp_ntz, open double, high double, low double, close double"), "1 hour", default_spread=0.0)
    book = execution.simulate(df.withColumns({"f": F.lit(1.0), "vol": F.lit(0.1)}), "f", execution.Costs(), max_drawdown=0.1).orderBy("time").collect()
    halted = [r["halted"] for r in book]
    assert any(halted) and halted == sorted(halted) and book[-1]["position"] == 0.0


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (float("nan"), 1.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"), -1)).collect()] == [-1.0, -1.0, -1.0, 1.5]
    lots = spark.createDataFrame([(0.299999999999,), (-0.019,), (0.004,), (99.0,)], "x double")
    assert [round(r[0], 9) for r in lots.select(lot_grid(F.col("x"), 0.01, 0.01, 50.0)).collect()] == [0.3, -0.01, 0.0, 50.0]
    assert all(abs(normal_cdf(normal_quantile(p)) - p) < 1e-12 for p in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999))


def test_statistics():
    assert abs(statistics.probabilistic_sharpe(0.0, 100) - 0.5) < 1e-12
    assert statistics.deflated_sharpe(0.1, 1000, 0.0, 3.0, 100, 0.001) < statistics.probabilistic_sharpe(0.1, 1000)
    lr, p = statistics.kupiec(1000, 50, 0.95)
    assert lr < 1e-9 and p > 0.99
    w = statistics.cap_weights(np.array([0.7, 0.2, 0.1]), 0.5)
    assert abs(w.sum() - 1) < 1e-12 and w.max() <= 0.5 + 1e-12
    hrp = statistics.hrp_weights(np.diag([1.0, 4.0, 9.0]))
    assert abs(hrp.sum() - 1) < 1e-12 and hrp[0] > hrp[1] > hrp[2]


def test_splits(spark):
    folds = splits.walk_forward(100, 40, 20, purge=2, embargo=3)
    assert [(f["train_from"], f["train_to"], f["test_from"], f["test_to"]) for f in folds] == [(0, 40, 45, 65), (20, 60, 65, 85), (40, 80, 85, 100)]
    assert len(splits.cpcv(60, 6, 2)) == 15 and len(splits.cpcv_paths(6, 2)) == 5
    assert splits.parse_axis("a=1:7:2") == ("a", [1.0, 3.0, 5.0, 7.0])
    pos = spark.range(100).select(F.col("id").alias("pos"))
    assert splits.membership(pos, splits.folds_frame(spark, folds)).groupBy("part").count().toPandas().set_index("part")["count"].to_dict() == {"train": 120, "test": 55}


def test_bootstrap_does_not_depend_on_layout(spark):
    r = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.01 * ((i * 7) % 5 - 2)) for i in range(60)], "date date, ret double")
    a = sorted(map(tuple, risk.bootstrap_means(r, 20, 5.0, seed=1).collect()))
    b = sorted(map(tuple, risk.bootstrap_means(r.repartition(3), 20, 5.0, seed=1).collect()))
    assert [x[0] for x in a] == [x[0] for x in b]
    np.testing.assert_allclose([x[1] for x in a], [x[1] for x in b], atol=1e-12)


def test_latch_and_blocks(spark):
    p = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 12)], "pos int")
    assert sorted(tuple(r) for r in islands.contiguous_blocks(p).collect()) == [(1, 3, 3), (7, 8, 2), (12, 12, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n2024-01-01 00:00:00,1,3,0.5,2.5,11\nbad,1,1,1,1,1\n2024-01-01 01:00:00,0,1,1,1,\n".replace("bad", ""))
    got = B.load_csv(spark, str(tmp_path / "a.csv"), "1 hour", default_spread=0.3).collect()
    assert len(got) == 1 and got[0]["spread"] == 0.3
    (tmp_path / "t.csv").write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2024.01.02\t03:00:00\t1\t2\t0.5\t1.5\t7\t0\t30\n")
    r = B.load_terminal_csv(spark, str(tmp_path / "t.csv"), "1 hour", point=0.01).head()
    assert (r["time"], r["volume"], round(r["spread"], 9)) == (dt.datetime(2024, 1, 2, 3), 7.0, 0.3)
    body = b"".join(struct.pack(">IIIIIf", 60 * i, 1000 + i, 1001 + i, 999 + i, 1002 + i, 5.0) for i in range(3)) + b"torn"
    (tmp_path / "2024-01-03.bi5").write_bytes(lzma.compress(body))
    c = candles.read_candles(spark, str(tmp_path / "2024-01-03.bi5"), scale=10.0).orderBy("time").collect()
    assert [(r["open"], r["low"], r["high"]) for r in c] == [(100.0, 99.9, 100.2), (100.1, 100.0, 100.3), (100.2, 100.1, 100.4)]
    assert c[1]["time"] == dt.datetime(2024, 1, 3, 0, 1)


def test_bar_store(spark, bars, tmp_path):
    m = B.save_bars(bars, str(tmp_path / "store"))
    assert m["n_rows"] == 520
    assert B.load_bars(spark, str(tmp_path / "store"), content=m["content_hash"]).count() == 520
    with pytest.raises(ValueError):
        B.load_bars(spark, str(tmp_path / "store"), content=1)
    with pytest.raises(ValueError):
        B.validate(bars.withColumn("high", F.col("low") * 0.5))


def test_calendars(spark, tmp_path):
    got = [r["time"] for r in macro.rule_calendar(spark, "2024-01-01", "2024-04-30").orderBy("time").collect()]
    assert got == [dt.datetime(2024, 1, 5, 13, 30), dt.datetime(2024, 2, 2, 13, 30), dt.datetime(2024, 3, 1, 13, 30), dt.datetime(2024, 4, 5, 12, 30)]
    free = {r[0] for r in macro.us_holidays(spark, 2024, 2024).collect()}
    assert {dt.date(2024, 5, 27), dt.date(2024, 11, 28), dt.date(2024, 1, 15), dt.date(2024, 6, 19)} <= free and len(free) == 11
    (tmp_path / "f.csv").write_text("observation_date,DGS10\n2024-01-01,.\n2024-01-02,4.0\n2024-01-03,4.5\n")
    assert macro.to_macro_frame(macro.parse_fred(spark, str(tmp_path / "f.csv"))).count() == 2


def test_queries_have_columns_of_their_sql():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 60
