"""Bar sizes: names, spacing, annual constants, warm-ups; and the days that bars belong to."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes of the named bar sizes.
MINUTES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440, "W1": 10080}
#: Hours that the market is open in a year of 52 weeks.
OPEN_HOURS = 119 * 52
#: Series that count in yields: their changes are differences.
YIELDS = ("us10y", "real10y", "us2y", "breakeven10y", "fedfunds")


def timeframe(name: str) -> str:
    """An interval such as '15 minutes', by a name in any case."""
    key = name.strip().upper()
    if key not in MINUTES:
        raise ValueError(f"unknown timeframe {name!r}; known: {', '.join(MINUTES)}")
    return f"{MINUTES[key]} minutes"


def bars_per_year(minutes: float) -> float:
    """Bars in a year of this size: trading days for daily bars, open hours below."""
    return 252.0 if minutes >= 1440 else OPEN_HOURS * 60 / minutes


def rank_window(years: float, minutes: float) -> int:
    """How many bars so many years hold."""
    return max(1, round(years * bars_per_year(minutes)))


def macro_warm_up(observations: int, minutes: float) -> int:
    """Bars that hold so many business days' observations."""
    return math.ceil(observations * 7 / 5 * 1440 / minutes)


def htf_warm_up(bars: int, htf_minutes: float, minutes: float) -> int:
    return math.ceil(bars * htf_minutes / minutes) + 1


def spacings(bars: DataFrame) -> DataFrame:
    """(series_id, minutes, n): how often each positive distance to the next bar occurs."""
    w = Window.partitionBy("series_id").orderBy("time")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (us(F.col("time")) - us(F.lag("time").over(w))) / 60_000_000
    return bars.select("series_id", gap.alias("minutes")).filter("minutes > 0").groupBy("series_id", "minutes").agg(F.count(F.lit(1)).alias("n"))


def duration(bars: DataFrame) -> DataFrame:
    """(series_id, minutes, median): the commonest spacing where it holds half of at least two, and the median one."""
    rows = spacings(bars)
    one = rows.groupBy("series_id").agg(F.max_by("minutes", F.struct("n", -F.col("minutes"))).alias("m"), F.max("n").alias("top"), F.sum("n").alias("all"), F.percentile("minutes", F.lit(0.5), F.col("n")).alias("median"))
    return one.select("series_id", F.when((F.col("top") >= 2) & (2 * F.col("top") >= F.col("all")), F.col("m")).alias("minutes"), "median")


def middle_date(time: Column, available: Column) -> Column:
    """The UTC date of a bar's middle."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.to_date(F.timestamp_micros(((us(time) + us(available)) / 2).cast("long")))


def default_lag(ticker: str) -> str:
    """When a vendor's daily close is known: later for futures, currencies and what trades with them."""
    return "22 hours 30 minutes" if ticker.endswith(("=F", "=X")) or ticker.startswith("DX") else "21 hours 30 minutes"


def is_yield(name: str, kind: str | None = None) -> bool:
    return kind == "yield" if kind else name.lower() in YIELDS


def thin(rows: DataFrame, most: int, order: str = "time") -> DataFrame:
    """Every k-th row of each series and its last, at most about `most`."""
    w = Window.partitionBy("series_id")
    r = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    step = F.ceil(F.col("__n") / most)
    return r.filter((F.col("__i") % step == 0) | (F.col("__i") == F.col("__n") - 1)).drop("__i", "__n")


def at_or_before(rows: DataFrame, at: str, order: str = "time") -> DataFrame:
    """The last row of each series at or before a time."""
    last = Window.partitionBy("series_id").orderBy(F.desc(order))
    return rows.filter(F.col(order) <= F.lit(at).cast("timestamp_ntz")).withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k")


def latest_so_far(times: list[Column], order: Column, by: list[str]) -> Column:
    """The running maximum of the latest of several times: when all that a row uses is known."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(F.greatest(*times) if len(times) > 1 else times[0]).over(w)
