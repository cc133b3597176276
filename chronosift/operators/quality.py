"""Data quality: gaps by class, outliers, spread quantiles, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import series


def classify_gap(start: Column, hours: Column) -> Column:
    """none, weekend (from Friday on, a day or more), daily_break (late evening, up to 4 h) or intraweek."""
    return (
        F.when(hours <= 1, "none")
        .when((hours >= 24) & (F.weekday(start) >= 4), "weekend")
        .when((hours <= 4) & F.hour(start).between(20, 23), "daily_break")
        .otherwise("intraweek")
    )


def spread_report(bars: DataFrame) -> DataFrame:
    """One row: quantiles of the spread, the widest bar, the share of flat bars."""
    q = F.percentile("spread", F.array(*[F.lit(x) for x in (0.01, 0.5, 0.99, 0.999)]))
    flat = F.avg((F.col("high") == F.col("low")).cast("double"))
    return bars.agg(q.alias("q"), F.max_by("time", F.struct("spread", "time")).alias("widest"), flat.alias("flat"), F.count(F.lit(1)).alias("n")).select(
        *[F.col("q")[i].alias(n) for i, n in enumerate(("spread_p01", "spread_p50", "spread_p99", "spread_p999"))], "widest", "flat", "n"
    )


def outliers(bars: DataFrame, n: int = 50, sigma: float = 5.0, top: int = 10) -> DataFrame:
    """The `top` largest returns in units of the preceding n bars' median |return| / 0.6745."""
    r = bars.withColumn("r", F.ln(F.col("close") / F.lag("close").over(series())))
    scale = F.percentile(F.abs("r"), F.lit(0.5)).over(series().rowsBetween(-n, -1)) / 0.6745
    z = r.withColumn("n", F.count("r").over(series().rowsBetween(-n, -1))).withColumn("z", F.try_divide(F.abs("r"), F.when(F.col("n") == n, scale)))
    return z.filter(F.col("z") > sigma).orderBy(F.desc("z"), "time").limit(top).select("time", "r", "z")
