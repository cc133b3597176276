"""Decisions that wait for an open market, and exits that a venue made by itself.

One step function serves tables and streams: a table is folded series by series; a stream keeps a series' pending decision and the rows that the
watermark hasn't passed as state, handles rows in the order of event time once it has, and lets event-time timers end what has expired. So any split
of the rows into batches gives the rows of the table, as far as the watermark has come; rows later than the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.ewm import by_series, spans, whole_series

OUT = "series_id long, decision_time timestamp, target double, outcome string, at timestamp, attempts int"
_EPS = 1e-9


@dataclass(frozen=True)
class Retry:
    """Seconds: how long new risk may wait, the first wait between attempts, and the longest."""

    most_wait: float = 5400.0
    wait: float = 30.0
    longest: float = 900.0


def reduces(target: float, current: float) -> bool:
    """Whether a target takes risk off: such decisions never go stale."""
    return abs(target) < abs(current) - _EPS and (abs(target) < _EPS or (target > 0) == (current > 0))


def expiry(pending: dict, rule: Retry) -> int | None:
    """The microsecond from which a pending decision is stale, or None if it never is."""
    return None if reduces(pending["target"], pending["current"]) else pending["time"] + round(rule.most_wait * 1e6)


def advance(pending: dict | None, row: dict, rule: Retry) -> tuple[dict | None, list[tuple]]:
    """What is pending after a row, and what became of decisions: (decision time, target, outcome, at, attempts).

    A row has time (microseconds) and kind: a 'decision' (target, current) takes the place of a pending one; a 'poll' (open) is an
    attempt, unless the last failed less than the wait ago, which doubles with every attempt.
    """
    out = []
    if pending and (end := expiry(pending, rule)) is not None and row["time"] > end:
        out.append((pending["time"], pending["target"], "expired", end, pending["attempts"]))
        pending = None
    if row["kind"] == "decision":
        if pending:
            out.append((pending["time"], pending["target"], "superseded", row["time"], pending["attempts"]))
        return {"time": row["time"], "target": row["target"], "current": row["current"], "attempts": 0, "next": row["time"]}, out
    if not pending or row["time"] < pending["next"]:
        return pending, out
    tries = pending["attempts"] + 1
    if row["open"]:
        out.append((pending["time"], pending["target"], "executed", row["time"], tries))
        return None, out
    return pending | {"attempts": tries, "next": row["time"] + round(min(rule.wait * 2 ** min(tries, 10), rule.longest) * 1e6)}, out


def _micros(times: pd.Series) -> list[int]:
    return (pd.to_datetime(times).astype("datetime64[us]").astype("int64")).tolist()


def _frame(key: int, out: list[tuple]) -> pd.DataFrame:
    stamp = lambda i: pd.to_datetime([r[i] for r in out], unit="us")
    return pd.DataFrame({"series_id": key, "decision_time": stamp(0), "target": [r[1] for r in out], "outcome": pd.Series([r[2] for r in out], dtype=object), "at": stamp(3), "attempts": pd.array([r[4] for r in out], "int32")})


def _rows(pdf: pd.DataFrame) -> list[dict]:
    cols = zip(_micros(pdf["time"]), pdf["seq"], pdf["kind"], pdf["target"].astype(float), pdf["current"].astype(float), pdf["open"].fillna(False), strict=True)
    return [{"time": t, "seq": int(s), "kind": k, "target": a, "current": b, "open": bool(o)} for t, s, k, a, b, o in cols]


def retried(events: DataFrame, rule: Retry = Retry()) -> DataFrame:
    """What became of each decision in a table of (series_id, time, seq, kind, target, current, open); what is still pending has no row.

    Rows of one time go by seq. A series is folded by one task, in batches of many series.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_series(batches, "series_id"):
            for s, e in spans(whole["series_id"].to_numpy()):
                one, pending, done = whole.iloc[s:e], None, []
                for row in sorted(_rows(one), key=lambda r: (r["time"], r["seq"])):
                    pending, out = advance(pending, row, rule)
                    done += out
                yield _frame(one["series_id"].iloc[0], done)

    needed = events.select("series_id", F.col("time").cast("timestamp").alias("time"), "seq", "kind", F.col("target").cast("double").alias("target"), F.col("current").cast("double").alias("current"), "open")
    return by_series(needed, "series_id", "time").mapInPandas(run, OUT)


_STATE = "pending string, waiting string"


def stream_retried(events: DataFrame, delay: str, rule: Retry = Retry()) -> DataFrame:
    """retried() of a stream, as far as its watermark (event time less delay) has come."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, waiting = map(json.loads, state.get) if state.exists else (None, [])
        for pdf in batches:
            waiting += _rows(pdf)
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted((r for r in waiting if r["time"] <= mark), key=lambda r: (r["time"], r["seq"]))
        waiting, done = [r for r in waiting if r["time"] > mark], []
        for row in ready:
            pending, out = advance(pending, row, rule)
            done += out
        end = expiry(pending, rule) if pending else None
        if end is not None and end < mark:
            done.append((pending["time"], pending["target"], "expired", end, pending["attempts"]))
            pending = end = None
        if pending is None and not waiting:
            state.remove()
        else:
            state.update((json.dumps(pending), json.dumps(waiting)))
            # the next row that the watermark reaches, or the next expiry
            wake = min([r["time"] for r in waiting] + ([end] if end is not None else []), default=None)
            if wake is not None:
                state.setTimeoutTimestamp(max(wake // 1000 + 1, mark // 1000 + 1))
        if done:
            yield _frame(key[0], done)

    needed = events.select("series_id", "time", "seq", "kind", F.col("target").cast("double").alias("target"), F.col("current").cast("double").alias("current"), "open")
    return needed.withWatermark("time", delay).groupBy("series_id").applyInPandasWithState(step, OUT, _STATE, "append", "EventTimeTimeout")


def with_fresh_static(read: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that joins each micro-batch with the static table as it is read at that moment.

    join is the batch join (an as-of join on availability, say), so a row sees what was published by its own time, also where that
    reached the table after the query began.
    """
    return lambda batch, number: sink(join(batch, read()), number)


def protective_exits(fills: DataFrame, bars: DataFrame) -> DataFrame:
    """(series_id, time, side, reason, exit_time, price): fills (series_id, time, side, sl, tp) that their own levels have closed.

    Bars count that close after a fill and by the next one of its series. A bar that opens beyond a level exits at the open, a stop
    goes before a target. The first bar that exits ends it; fills without levels, and those that stand, give no row.
    """
    w = Window.partitionBy("series_id").orderBy("__t", "__bar").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["time", "side", "sl", "tp"]
    f = fills.select("series_id", F.col("time").alias("__t"), F.lit(1).alias("__bar"), F.struct(*names).alias("__f"))
    b = bars.select("series_id", F.col("available_at").alias("__t"), F.lit(0).alias("__bar"), F.struct("available_at", "open", "high", "low").alias("__b"))
    rows = f.unionByName(b, allowMissingColumns=True).withColumn("__f", F.last("__f", ignorenulls=True).over(w)).filter(F.col("__b").isNotNull() & F.col("__f").isNotNull())
    rows = rows.select("series_id", *[F.col(f"__f.{n}").alias(n) for n in names], F.col("__b.available_at").alias("exit_time"), "__b.open", "__b.high", "__b.low")
    up = F.col("side") > 0
    beyond = lambda x, level, below: F.coalesce(F.when(below, x <= level).otherwise(x >= level), F.lit(False))
    o, sl, tp = F.col("open"), F.col("sl"), F.col("tp")
    worst, best = F.when(up, F.col("low")).otherwise(F.col("high")), F.when(up, F.col("high")).otherwise(F.col("low"))
    hit = (
        F.when(beyond(o, sl, up), F.struct(F.lit("stop").alias("reason"), o.alias("price")))
        .when(beyond(o, tp, ~up), F.struct(F.lit("target").alias("reason"), o.alias("price")))
        .when(beyond(worst, sl, up), F.struct(F.lit("stop").alias("reason"), sl.alias("price")))
        .when(beyond(best, tp, ~up), F.struct(F.lit("target").alias("reason"), tp.alias("price")))
    )
    out = rows.filter("side <> 0").withColumn("__x", hit).filter(F.col("__x").isNotNull())
    first = out.groupBy("series_id", "time", "side").agg(F.min_by(F.struct("__x", "exit_time"), "exit_time").alias("x"))
    return first.select("series_id", "time", "side", F.col("x.__x.reason").alias("reason"), F.col("x.exit_time").alias("exit_time"), F.col("x.__x.price").alias("price"))
