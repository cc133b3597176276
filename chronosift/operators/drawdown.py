"""Equity curves: drawdowns, their length, worst windows, monthly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drawdowns(equity: DataFrame, value: str = "equity", order: str = "date", partition: list[str] | None = None) -> DataFrame:
    """Adds peak and drawdown (equity / peak - 1)."""
    w = Window.partitionBy(*(partition or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def drawdown_spells(equity: DataFrame, value: str = "equity", order: str = "date", partition: list[str] | None = None) -> DataFrame:
    """Adds the time of the last peak and of the next recovery (or the last time)."""
    keys = partition or []
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = drawdowns(equity, value, order, partition).withColumn("at_peak", F.when(F.col("drawdown") >= 0, F.col(order)))
    return d.withColumn("peak_time", F.last("at_peak", ignorenulls=True).over(back)).withColumn("recovery_time", F.coalesce(F.first("at_peak", ignorenulls=True).over(ahead), F.max(order).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("at_peak")


def simple_returns(equity: DataFrame, value: str = "equity", order: str = "date", partition: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    return equity.withColumn("ret", F.col(value) / F.lag(value).over(w) - 1)


def worst_windows(returns: DataFrame, windows: list[int], ret: str = "ret", order: str = "date") -> DataFrame:
    """For each length: the worst compounded return and the last day of its window."""
    w = Window.orderBy(order)
    rows = returns.filter(F.col(ret).isNotNull())
    parts = []
    for n in windows:
        f = w.rowsBetween(-(n - 1), 0)
        x = rows.select(order, F.when(F.count(ret).over(f) == n, F.exp(F.sum(F.log1p(ret)).over(f)) - 1).alias("r")).filter("r IS NOT NULL")
        parts.append(x.agg(F.lit(n).alias("days"), F.min("r").alias("worst"), F.min_by(order, F.struct("r", order)).alias("last_day")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def monthly_rollup(returns: DataFrame, ret: str = "ret", order: str = "date") -> DataFrame:
    """Compounded return by year and month, by year (month null) and in all (both null)."""
    rows = returns.filter(F.col(ret).isNotNull()).select(F.year(order).alias("year"), F.month(order).alias("month"), F.log1p(ret).alias("g"))
    return rows.rollup("year", "month").agg((F.exp(F.sum("g")) - 1).alias("compounded"), F.count(F.lit(1)).alias("days"))


def monthly_pivot(returns: DataFrame, ret: str = "ret", order: str = "date") -> DataFrame:
    rows = returns.filter(F.col(ret).isNotNull()).select(F.year(order).alias("year"), F.month(order).alias("month"), F.log1p(ret).alias("g"))
    out = rows.groupBy("year").pivot("month", list(range(1, 13))).agg(F.exp(F.sum("g")) - 1)
    return out.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])
