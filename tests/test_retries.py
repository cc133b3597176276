"""Deferred decisions: streams in any split of batches against tables; protective exits against a loop."""

import datetime as dt
import random

import pytest
from chronosift.operators.execution import intrabar_exit
from chronosift.streaming import retries
from chronosift.streaming.bars import run_available
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
KIND = "series_id long, time timestamp, seq long, kind string, target double, current double, open boolean"
RULE = retries.Retry(most_wait=3000.0, wait=60.0, longest=600.0)


def _events(n=240):
    rng = random.Random(9)
    rows, at = [], T0
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([20, 90, 400, 2500]))
        s = rng.randrange(3)
        if rng.random() < 0.3:
            rows.append((s, at, i, "decision", float(rng.randrange(-2, 3)), float(rng.randrange(-3, 4)), None))
        else:
            rows.append((s, at, i, "poll", None, None, rng.random() < 0.2))
    return rows


def _key(r):
    return (r["series_id"], r["decision_time"], r["target"], r["outcome"], r["at"], r["attempts"])


@pytest.mark.parametrize("files", [1, 6])
def test_any_split_gives_the_table(spark, tmp_path, files):
    rows = _events()
    last = max(r[1] for r in rows)
    # everything expires before the last rows, which move the watermark
    closing = [(s, last + dt.timedelta(hours=3), 9000 + s, "poll", None, None, False) for s in range(3)] + [(7, last + dt.timedelta(hours=9), 9999, "poll", None, None, False)]
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    rng = random.Random(files)
    for i, part in enumerate([*parts, closing]):
        rng.shuffle(part)  # late within the watermark's delay, but for what a part ends with
        spark.createDataFrame(sorted(part, key=lambda r: r[1]), KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        spark.read.parquet(f"{tmp_path}/in/{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
        stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/all")
        run_available(retries.stream_retried(stream, "10 minutes", RULE), lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/ck")
    want = sorted(map(_key, retries.retried(spark.createDataFrame([*rows, *closing], KIND), RULE).collect()), key=str)
    got = sorted(map(_key, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == want and {w[3] for w in want} == {"executed", "expired", "superseded"}


def test_reductions_never_expire_and_waits_double(spark):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, t(0), 0, "decision", 1.0, 3.0, None), *[(1, t(s), s, "poll", None, None, False) for s in (1, 100, 121, 200, 400)], (1, t(90_000), 90_000, "poll", None, None, True)]
    rows += [(2, t(0), 0, "decision", -1.0, 3.0, None), (2, t(90_000), 90_000, "poll", None, None, True), (3, t(5), 5, "poll", None, None, True)]
    got = {r["series_id"]: (r["outcome"], r["at"], r["attempts"]) for r in retries.retried(spark.createDataFrame(rows, KIND), RULE).collect()}
    # tries at 1, then 120 s later (121), then 240 s later (400), then the open market
    assert got == {1: ("executed", t(90_000), 4), 2: ("expired", t(3000), 0)}
    assert retries.retried(spark.createDataFrame([], KIND), RULE).count() == 0


def test_protective_exits_equal_a_loop(spark):
    rng = random.Random(5)
    bars, fills = [], []
    for s in (1, 2):
        price = 100.0
        for i in range(200):
            open_ = price + rng.gauss(0, 1)
            price = open_ + rng.gauss(0, 1)
            bars.append((s, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + 1), open_, max(open_, price) + rng.random(), min(open_, price) - rng.random()))
            if rng.random() < 0.15:
                side = rng.choice([-1, 0, 1])
                fills.append((s, T0 + dt.timedelta(hours=i, minutes=30 * rng.randrange(3)), side, None if rng.random() < 0.3 else price - (side or 1) * 2.0, None if rng.random() < 0.3 else price + (side or 1) * 3.0))
    fills = list({(f[0], f[1]): f for f in fills}.values())
    got = {(r["series_id"], r["time"]): (r["side"], r["reason"], r["exit_time"], r["price"]) for r in retries.protective_exits(spark.createDataFrame(fills, "series_id long, time timestamp_ntz, side int, sl double, tp double"), spark.createDataFrame(bars, "series_id long, time timestamp_ntz, available_at timestamp_ntz, open double, high double, low double")).collect()}
    want = {}
    for s, at, side, sl, tp in fills:
        after = min((f[1] for f in fills if f[0] == s and f[1] > at), default=None)
        for b in bars:
            if b[0] == s and b[2] > at and (after is None or b[2] <= after):
                why, price = intrabar_exit(side, b[3], b[4], b[5], sl, tp)
                if why:
                    want[s, at] = (side, why, b[2], price)
                    break
    assert got == want and {w[1] for w in want.values()} == {"stop", "target"}


def test_static_side_is_read_for_each_batch(spark, tmp_path):
    rates, out = str(tmp_path / "rates"), []
    put = lambda *rows: spark.createDataFrame(rows, "available_at timestamp, rate double").write.mode("append").parquet(rates)
    from chronosift.operators.asof import asof_join

    sink = retries.with_fresh_static(lambda: spark.read.parquet(rates), lambda batch, known: asof_join(batch, known, columns=["rate"]), lambda b, n: out.extend(b.collect()))
    put((T0, 1.0))
    for i in range(2):
        spark.createDataFrame([(T0 + dt.timedelta(hours=2 * i + 1), i)], "time timestamp, n int").write.mode("append").parquet(f"{tmp_path}/in")
        run_available(spark.readStream.schema("time timestamp, n int").parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/ck")
        put((T0 + dt.timedelta(hours=2), 2.0))
    assert [(r["n"], r["rate"]) for r in sorted(out, key=lambda r: r["n"])] == [(0, 1.0), (1, 2.0)]
