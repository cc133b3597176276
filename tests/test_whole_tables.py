"""Registered queries work on whole tables."""

import datetime as dt

import pytest

from chronosift import catalogue

DAYS, HOURS = 2303, 733


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    orders = [(dt.datetime(1995, 1, 1) + dt.timedelta(days=i), 100.0 + i % 13) for i in range(DAYS)]
    spark.createDataFrame(orders, "o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    events = [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i, minutes=7 * i % 60), 50.0 + i * 37 % 101) for i in range(HOURS)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{path}/events.parquet")
    return path


def test_rollover_nights_of_all_events(spark, sf):
    got = {r["event_id"]: r["nights"] for r in catalogue.queries()["rollover_nights"](spark, sf).collect()}
    want = {}
    for e in spark.read.parquet(f"{sf}/events.parquet").collect():
        stop = e["ts"] + dt.timedelta(hours=e["event_id"] % 200)
        at = [dt.datetime(2023, 12, 30, 21) + dt.timedelta(days=i) for i in range(60)]
        want[e["event_id"]] = sum((1, 1, 3, 1, 1, 0, 0)[x.weekday()] for x in at if e["ts"] < x <= stop)
    assert len(got) == HOURS and got == want


def test_folds_reach_the_last_day(spark, sf):
    got = {tuple(r) for r in catalogue.queries()["walk_forward_membership"](spark, sf).select("fold", "part", "pos").collect()}
    want = set()
    for fold, start in enumerate(range(500, DAYS - 15, 250)):
        want |= {(fold, "train", i) for i in range(start - 500, start)} | {(fold, "test", i) for i in range(start + 15, min(start + 265, DAYS))}
    assert got == want and max(p for _, part, p in got if part == "test") == DAYS - 1


def test_book_reaches_the_last_bar(spark, sf):
    got = catalogue.queries()["walk_forward_book"](spark, sf).select("time", "fold").collect()
    start = dt.datetime(2024, 1, 1)
    assert sorted(r["time"] for r in got) == [start + dt.timedelta(hours=i) for i in range(204, HOURS)]
