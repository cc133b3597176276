"""Positions and running sums in ranges against plain ones."""

import random

import pytest
from chronosift.operators import positions
from pyspark.sql import functions as F


def test_numbers_and_sums(spark):
    rng = random.Random(1)
    keys = [rng.choice([rng.randrange(50), 10**12 + rng.randrange(5000)]) * 10_000 + i for i in range(3000)]
    got = {r["k"]: r["pos"] for r in positions.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(7), "k", ranges=16).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    rows = spark.createDataFrame([(i / 100, float(i % 7)) for i in range(100)], "p double, v double").repartition(5)
    sums = {round(r["p"] * 100): r["s"] for r in positions.carried(rows, positions.banded(F.col("p"), 8), ["p"], F.col("v"), "s", own=True).collect()}
    assert sums == {i: sum(j % 7 for j in range(i + 1)) for i in range(100)}
    assert positions.numbered(rows.limit(0).select(F.lit(1).alias("k")), "k").count() == 0


def test_area_under_the_curve(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.0, rng.random(), 0.25]), rng.random() < 0.4, rng.random()) for _ in range(400)]
    rows = [(p, float(y), w) for p, y, w in rows]
    up, down = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    want = sum(a[2] * b[2] * (1.0 if a[0] > b[0] else 0.5 if a[0] == b[0] else 0.0) for a in up for b in down) / sum(a[2] for a in up) / sum(b[2] for b in down)
    df = spark.createDataFrame(rows, "p double, y double, w double").repartition(3)
    assert positions.auc(df, weight="w").head()["auc"] == pytest.approx(want)
    assert positions.auc(df.filter("y > 0")).head()["auc"] is None
