import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronosift.operators import splits
from chronosift.operators.execution import Costs
from chronosift.plans import models, research_runs, rules
from chronosift.sources import synthetic


def test_garch_finds_persistence():
    rng, v, r = np.random.default_rng(5), 1.0, []
    for _ in range(3000):
        x = rng.normal() * np.sqrt(v)
        r.append(x)
        v = 0.05 + 0.1 * x * x + 0.85 * v
    m = models.fit_garch(np.array(r))
    assert 0.85 < m["alpha"] + m["beta"] < 0.9995 and 0.03 < m["alpha"] < 0.2
    assert models.fit_garch(np.array(r[:100])) is None


def test_hmm_separates_regimes_and_is_causal():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.5, 300), rng.normal(0, 3, 300), rng.normal(0, 0.5, 300)])
    h = models.GaussianHmm(2).fit(x)
    p = h.filter(x)[:, 0]
    assert p[50:280].mean() > 0.9 and p[350:580].mean() < 0.1
    np.testing.assert_allclose(h.filter(x[:400])[:, 0], p[:400])


def test_har_is_least_squares(spark):
    rng = np.random.default_rng(3)
    rv = np.exp(rng.normal(0, 0.3, 120))
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    got = models.har(spark.createDataFrame([(0, d, float(v)) for d, v in zip(days, rv, strict=True)], "series_id long, date date, rv double"), "2024-04-01").orderBy("date").toPandas()
    s = pd.Series(rv)
    x = np.column_stack([np.ones(120), s, s.rolling(5).mean(), s.rolling(22).mean()])
    rows = [i for i in range(21, 119) if days[i + 1] < dt.date(2024, 4, 1)]
    beta = np.linalg.lstsq(x[rows], rv[[i + 1 for i in rows]], rcond=None)[0]
    np.testing.assert_allclose(got["har"].iloc[30], max(x[30] @ beta, 0), rtol=1e-6)


def test_walk_forward_uses_training_bars_only(spark, tmp_path):
    synthetic.make_bars(spark, 400, seed=4).write.parquet(f"{tmp_path}/b")
    bars = spark.read.parquet(f"{tmp_path}/b")
    folds = splits.walk_forward(400, 150, 100, purge=2)
    picked = {n: rules.RULES[n] for n in ("donchian", "zscore_fade")}
    a = research_runs.fold_weights(bars, picked, folds).filter("fold = 0").toPandas().set_index("strategy")["weight"]
    late = sorted(r[0] for r in bars.select("time").collect())[150]
    bent = bars.withColumn("close", F.when(F.col("time") >= F.lit(late), F.col("close") * 2).otherwise(F.col("close")))
    b = research_runs.fold_weights(bent, picked, folds).filter("fold = 0").toPandas().set_index("strategy")["weight"]
    np.testing.assert_allclose(a.sort_index(), b.sort_index())
    assert abs(a.sum() - 1) < 1e-12
    book = research_runs.walk_forward(bars, picked, folds, Costs())
    assert book.count() == sum(f["test_to"] - f["test_from"] for f in folds)


def test_sweep_and_deflation(spark, tmp_path):
    synthetic.make_bars(spark, 200, seed=6).write.parquet(f"{tmp_path}/b")
    table = research_runs.sweep(spark.read.parquet(f"{tmp_path}/b"), rules.RULES["zscore_fade"], "zscore_fade", {"n": [10, 20], "enter": [1.0, 2.0]}, Costs())
    rows = research_runs.deflate(table)
    assert len(rows) == 4 and all(r["dsr"] <= r["psr"] + 1e-12 for r in rows if r["sr"] is not None)
    best = {(r["n"], r["enter"]): r for r in rows}
    np.testing.assert_allclose(best[10, 1.0]["plateau"], np.mean([best[k]["sr"] for k in best if k != (10, 1.0)]))
