"""Interval joins: events around instants, blackouts, label spans.

Both sides are cut into time slices of the interval's order of length, so that the join is an equi
join on slices with the exact condition behind it, never a product of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.operators import positions

def _seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1_000_000


def _sliced(rows: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    first, last = F.floor(low / width), F.floor(high / width)
    return rows.withColumn("__slice", F.explode(F.sequence(first, last)))


def within(points: DataFrame, spans: DataFrame, *, time: str = "time", start: str = "start", stop: str = "stop", how: str = "left_semi", width: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Points in [start, stop] of some span: left_semi or left_anti. Times are timestamps."""
    on = on or []
    width = width or 86400.0
    p = points.withColumns({"__slice": F.floor(_seconds(F.col(time)) / width), "__p": F.unix_micros(F.col(time).cast("timestamp"))})
    s = spans.select(*on, F.unix_micros(F.col(start).cast("timestamp")).alias("__a"), F.unix_micros(F.col(stop).cast("timestamp")).alias("__b"))
    s = _sliced(s, F.col("__a") / 1_000_000, F.col("__b") / 1_000_000, width)
    same = p["__slice"] == s["__slice"]
    for k in on:
        same = same & (p[k] == s[k])
    return p.join(s, same & (F.col("__p") >= F.col("__a")) & (F.col("__p") <= F.col("__b")), how).drop("__slice", "__p")


def blackout_spans(events: DataFrame, *, before: str, after: str, min_importance: int = 1, time: str = "time") -> DataFrame:
    """The span around each event of at least min_importance; unknown importance counts as high."""
    some = events.filter(F.coalesce("importance", F.lit(3)) >= min_importance)
    return some.select((F.col(time) - F.expr(f"INTERVAL {before}")).alias("start"), (F.col(time) + F.expr(f"INTERVAL {after}")).alias("stop"))


def counts_within(points: DataFrame, events: DataFrame, spans: dict[str, tuple[int, int]], *, time: str = "time", at: str = "time", width: int = 3_600_000_000) -> DataFrame:
    """points with a number of events a span: of those from time + low on and before time + high, in microseconds.

    Each count is the difference of two running counts, so that no point is held against its events. Running counts go by ranges of `width`.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    offsets = sorted({x for span in spans.values() for x in span})
    marks = points.select(us(time).alias("__us")).filter("__us IS NOT NULL").distinct().withColumn("__off", F.explode(F.array(*[F.lit(x).cast("long") for x in offsets])))
    marks = marks.select("__us", "__off", (F.col("__us") + F.col("__off")).alias("__x"), F.lit(0).cast("long").alias("__n"))
    none = F.lit(None).cast("long")
    held = events.select(us(at).alias("__x")).filter("__x IS NOT NULL").groupBy("__x").agg(F.count(F.lit(1)).alias("__n")).select(none.alias("__us"), none.alias("__off"), "__x", "__n")
    # marks stand before the events of their instant, and count for nothing
    place = F.when(F.col("__off").isNull(), 1).otherwise(0)
    so_far = positions.carried(marks.union(held), F.floor(F.col("__x") / width), ["__x", place], F.col("__n"), "__c").filter("__off IS NOT NULL")
    until = lambda x: F.max(F.when(F.col("__off") == x, F.col("__c")))
    counts = so_far.groupBy("__us").agg(*[(until(high) - until(low)).alias(name) for name, (low, high) in spans.items()])
    joined = points.join(counts, us(time) == F.col("__us"), "left").drop("__us")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)).cast("long") for name in spans})
