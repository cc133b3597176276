from pyspark.sql import functions as F

from chronosift.operators import desk


def test_order_legs():
    assert desk.order_legs(1.0, [(1, 1.0)]) == []
    assert desk.order_legs(0.0, [(1, 1.0), (2, 0.5)]) == [{"kind": "close", "ticket": 1, "lots": 1.0}, {"kind": "close", "ticket": 2, "lots": 0.5}]
    assert desk.order_legs(-1.0, [(1, 1.0)]) == [{"kind": "close", "ticket": 1, "lots": 1.0}, {"kind": "open", "ticket": None, "lots": -1.0}]
    assert desk.order_legs(0.4, [(1, 1.0)]) == [{"kind": "close", "ticket": 1, "lots": 0.6}]
    assert [x["lots"] for x in desk.order_legs(12.0, [])] == [5.0, 5.0, 2.0]


def test_overlay_never_flips_or_enlarges(spark):
    rows = [(0.5, "veto", None, 0.9), (0.5, "scale", 3.0, 0.9), (0.5, "override", -1.0, 0.9), (-0.5, "scale", 0.5, 0.9), (0.5, "veto", None, 0.1), (0.5, None, None, None)]
    df = spark.createDataFrame(rows, "q double, action string, scale double, confidence double")
    got = [r[0] for r in df.select(desk.bounded_decision(F.col("q"), F.col("action"), F.col("scale"), F.col("confidence"))).collect()]
    assert got == [0.0, 0.5, 0.0, -0.25, 0.5, 0.5]


def test_slippage(spark):
    fills = spark.createDataFrame([(0, i, 100.1 if i % 2 else 99.9, 100.0, 1.0 if i % 2 else -1.0, 0.2) for i in range(4)], "series_id long, time long, price double, mid double, lots double, spread double")
    r = desk.slippage_summary(fills).head()
    assert r["fills"] == 4 and abs(r["shortfall"] - 0.1) < 1e-9 and abs(r["half_spreads"] - 1.0) < 1e-9
