"""Risk reports against plain Python."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from chronosift.functions.statistics import cornish_fisher, kupiec
from chronosift.operators import reports


def test_report_of_each_account(spark):
    rng = random.Random(7)
    paths, rows = {}, []
    for name, n in (("a", 200), ("b", 120), ("short", 8)):
        value, path = 1000.0, []
        for i in range(n):
            value *= math.exp(rng.gauss(0, 0.02))
            path.append(value)
            rows.append((name, dt.date(2024, 1, 1) + dt.timedelta(days=i), value, 500.0 + i))
        paths[name] = path
    rows.append(("a", dt.date(2030, 1, 1), None, 1.0))
    df = spark.createDataFrame(rows, "name string, date date, equity double, held double").repartition(4)
    got = {r["name"]: r for r in reports.risk_report(df, ["name"], window=60, exposure="held", shocks={"crash": -0.2}).collect()}
    for name in ("a", "b"):
        v = np.array(paths[name])
        r, g = v[1:] / v[:-1] - 1, got[name]
        q = np.quantile(r, 0.05)
        m, s = r.mean(), r.std(ddof=1)
        skew, kurt = ((r - m) ** 3).mean() / r.std() ** 3, ((r - m) ** 4).mean() / r.std() ** 4
        z = statistics.NormalDist().inv_cdf(0.05)
        hit = [(x, np.quantile(r[i - 60 : i], 0.05)) for i, x in enumerate(r) if i >= 60]
        breaches = sum(x < y for x, y in hit)
        dd = 1 - v / np.maximum.accumulate(v)
        assert (g["periods"], g["tests"], g["breaches"]) == (len(r), len(hit), breaches)
        assert g["var_historical"] == pytest.approx(-q) and g["es_historical"] == pytest.approx(-r[r <= q].mean())
        assert g["var_gaussian"] == pytest.approx(-(m + z * s)) and g["es_gaussian"] == pytest.approx(-(m - math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / 0.05 * s))
        assert g["var_cornish_fisher"] == pytest.approx(-(m + cornish_fisher(0.05, skew, kurt - 3) * s))
        assert (g["kupiec"], g["kupiec_p"]) == pytest.approx(kupiec(len(hit), breaches, 0.95), rel=1e-6)
        assert (g["max_drawdown"], g["current_drawdown"], g["worst"], g["best"]) == pytest.approx((dd.max(), dd[-1], r.min(), r.max()))
        assert g["crash"] == pytest.approx(-0.2 * (500 + len(v) - 1) / v[-1])
    assert got["short"]["var_historical"] is None and got["short"]["kupiec"] is None and got["short"]["periods"] == 7
    assert reports.risk_report(df.limit(0), ["name"]).count() == 0
