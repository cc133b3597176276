"""Features across time frames see no later price; a decision's parts add up."""

from chronosift import catalogue
from chronosift.plans import combination, crossframes
from chronosift.plans.features import leakage
from chronosift.sources import tables as T
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_no_later_price_shows(spark):
    bars = T.bars(spark, SF).cache()
    out = crossframes.cross_features(bars, {"h4": "4 hours", "d1": "1 day"})
    columns = [c for c in out.columns if c not in bars.columns]
    assert len(columns) == 15 + 11
    for cut in ("2024-01-12 10:00:00", "2024-01-20 00:00:00"):
        assert leakage(lambda b: crossframes.cross_features(b, {"h4": "4 hours", "d1": "1 day"}), bars, cut, columns) == 0


def test_parts_of_a_decision_add_up(spark):
    rows = spark.createDataFrame([(0.5, -1.0), (1.0, 1.0), (None, 0.2)], "a double, b double")
    fitted = spark.createDataFrame([("a", 0.75, 1.2), ("b", 0.25, 1.2)], "strategy string, weight double, fdm double")
    got = combination.attribution(rows, ["a", "b"], fitted, 0.8)
    assert got.filter(F.abs(F.col("contribution_a") + F.col("contribution_b") - F.col("combined") - F.col("clipped")) > 1e-12).count() == 0
    assert sorted((round(r["combined"], 9), round(r["clipped"], 9)) for r in got.collect()) == [(0.06, 0.0), (0.15, 0.0), (0.8, 0.4)]


def test_new_queries_are_registered_with_sql():
    without = {"seasonal_positions", "regime_states"}
    from chronosift.plans import learning_queries, studies

    names = set(learning_queries._Q) | set(studies._Q)
    assert names <= set(catalogue.queries()) and names - without == names & set(catalogue.oracle_sql())
