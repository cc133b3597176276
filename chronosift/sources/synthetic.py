"""Seeded synthetic bars and events. Draws are hashes of (seed, series, bar), whatever the layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _normal(seed: int, salt: int) -> Column:
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt + k), "series_id", "i"), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * math.pi * unit(1))


MODELS = ("gbm", "trend", "mean_revert", "regime", "jump")


def make_bars(spark: SparkSession, n: int, *, series: int = 1, seed: int = 0, start: str = "2020-01-06", annual_vol: float = 0.16, drift: float = 0.0, jump: float = 0.0, price: float = 1800.0, spread: float = 0.3, weekend_gaps: bool = True, model: str = "gbm") -> DataFrame:
    """Hourly bars of a model, with rare jumps of `jump` if that isn't 0.

    gbm: independent returns. trend: returns that carry on (AR(1), 0.1). mean_revert: log prices that fall back to their
    start (a fiftieth a bar). regime: calm and wild spells of about 250 bars. jump: gbm with jumps of five deviations.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    sd = annual_vol / math.sqrt(6048)
    rows = spark.range(series * n).select((F.col("id") / n).cast("long").alias("series_id"), (F.col("id") % n).alias("i"))
    hop = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(9), "series_id", "i"), F.lit(500)) == 0, jump * _normal(seed, 20)).otherwise(0.0)
    w = Window.partitionBy("series_id").orderBy("i")
    z = sd * _normal(seed, 0)
    if model == "regime":
        spell = F.pmod(F.xxhash64(F.lit(seed), F.lit(31), "series_id", F.floor(F.col("i") / 250)), F.lit(3))
        z = z * F.when(spell == 0, 2.5).otherwise(0.7)
    if model == "jump":
        hop = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(9), "series_id", "i"), F.lit(200)) == 0, 5 * sd * _normal(seed, 20)).otherwise(0.0)
    rows = rows.withColumn("r", drift / 6048 + z + hop)
    if model in ("trend", "mean_revert"):
        # sums of shocks whose weights fade are a bounded frame: what is older weighs less than 1e-8
        fade, reach = (0.1, 8) if model == "trend" else (0.98, 900)
        past = F.collect_list("r").over(w.rowsBetween(-reach, 0))
        faded = F.aggregate(past, F.lit(0.0), lambda a, x: a * fade + x)
        rows = rows.withColumn("__f", faded)
        rows = rows.withColumn("r", F.col("__f") if model == "trend" else F.col("__f") - F.coalesce(F.lag("__f").over(w), F.lit(0.0))).drop("__f")
    rows = rows.withColumn("close", price * F.exp(F.sum("r").over(w))).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(price)))
    up, down = F.abs(_normal(seed, 4)) * sd / 2, F.abs(_normal(seed, 6)) * sd / 2
    rows = rows.withColumns({"high": F.greatest("open", "close") * F.exp(up), "low": F.least("open", "close") * F.exp(-down), "volume": F.floor(100 + 900 * F.abs(_normal(seed, 8))).cast("double"), "spread": F.lit(spread)})
    # the market is open 119 hours a week, from Sunday 22:00 to Friday 21:00
    hours = F.floor(F.col("i") / 119) * 168 + F.col("i") % 119 if weekend_gaps else F.col("i")
    begin = F.lit(start).cast("timestamp") - F.expr("INTERVAL 2 HOURS") if weekend_gaps else F.lit(start).cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(begin) + hours * 3600).cast("timestamp_ntz")
    return rows.withColumn("time", at).withColumn("available_at", F.col("time") + F.expr("INTERVAL 1 HOUR")).select("series_id", "time", "open", "high", "low", "close", "volume", "spread", "available_at")


def make_macro(bars: DataFrame, *, seed: int = 0) -> DataFrame:
    """(name, date, value, available_at): business-day series that move with (spx) or against (dxy, real10y) the bars' days, or alone."""
    days = bars.groupBy(F.to_date("time").alias("date")).agg(F.max_by("close", "time").alias("c")).filter(F.weekday("date") < 5)
    w = Window.orderBy("date")
    days = days.withColumns({"series_id": F.lit(0).cast("long"), "i": F.row_number().over(w).cast("long"), "g": F.coalesce(F.ln(F.col("c") / F.lag("c").over(w)), F.lit(0.0))})
    # name, start, beta to the bars, own deviation, in yields
    kinds = (("dxy", 100.0, -0.4, 0.004, False), ("spx", 3000.0, 0.1, 0.01, False), ("vix", 18.0, -0.5, 0.05, False), ("us10y", 2.5, -1.0, 0.03, True), ("real10y", 0.5, -1.5, 0.03, True))
    out = None
    for k, (name, start, beta, sd, level) in enumerate(kinds):
        step = days.withColumn("s", beta * F.col("g") * (10.0 if level else 1.0) + sd * _normal(seed, 100 + 10 * k))
        total = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
        one = step.select(F.lit(name).alias("name"), "date", (start + total if level else start * F.exp(total)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("available_at", F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL '21:30' HOUR TO MINUTE"))


def make_events(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Payrolls and committee statements by schedule, and consumer prices on the second Wednesday of each month."""
    from .schedule import calendar, new_york

    months = spark.sql(f"SELECT explode(sequence(trunc(DATE '{start}', 'MM'), DATE '{end}', INTERVAL 1 MONTH)) AS m")
    day = F.date_add(F.next_day(F.date_sub("m", 1), "Wed"), 7)
    cpi = months.select(new_york(day, F.lit("08:30")).alias("time"), F.lit("CPI").alias("name"), F.lit("USD").alias("currency"), F.lit(3).cast("long").alias("importance"), F.lit("synthetic").alias("source"), F.lit(True).alias("approximate"))
    inside = (F.col("time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return calendar(spark, start, end).unionByName(cpi.filter(inside))
