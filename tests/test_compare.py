import datetime as dt

from chronosift import cli
from chronosift.operators.compare import parity_report, prior_looks, research_window

T0 = dt.datetime(2024, 1, 1)


def test_parity(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 5.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 2.5), (2, 4.0, 3.0), (4, 5.0, 1.0)], "k int, x double, y double")
    got = {r["column"]: (r["rows"], r["mismatches"], r["null_mismatches"]) for r in parity_report(a, b, ["x", "y"], ["k"]).collect()}
    assert got == {"x": (2, 0, 1), "y": (2, 1, 0)}


def test_windows(spark):
    bars = spark.createDataFrame([(T0 + dt.timedelta(hours=6 * i),) for i in range(40)], "time timestamp_ntz")
    assert research_window(bars, start="2024-01-02", end="2024-01-03").count() == 8
    spent = spark.createDataFrame([(T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2), "b")], "start timestamp_ntz, end timestamp_ntz, config_hash string")
    assert research_window(bars, holdout="2024-01-09", spent=spent).count() == 4
    assert prior_looks(spent, start="2024-01-03", end="2024-01-05", config_hash="a").count() == 1
    assert prior_looks(spent, start="2024-01-03", end="2024-01-05", config_hash="b").count() == 0


def test_command_line(capsys):
    assert cli.main(["features"]) == 0 and "calendar" in capsys.readouterr().out
    assert cli.main(["rules"]) == 0 and "tsmom" in capsys.readouterr().out
