"""Macro series with publication lags, and the calendar of scheduled events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_fred(spark: SparkSession, path: str) -> DataFrame:
    """(date, value) from a CSV with a date column and one value column, where '.' is missing."""
    raw = spark.read.option("header", True).option("nullValue", ".").csv(path)
    day, value = raw.columns[0], raw.columns[-1]
    return raw.select(F.to_date(day).alias("date"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("value")).filter("value IS NOT NULL AND date IS NOT NULL")


def to_macro_frame(values: DataFrame, lag: str = "21 hours 30 minutes", *, seq: str | None = None) -> DataFrame:
    """(date, value, available_at): finite values only, the last row of a date, published after the lag."""
    rows = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    last = rows.groupBy("date").agg(F.max_by("value", F.col(seq) if seq else F.lit(0)).alias("value"))
    return last.withColumn("available_at", F.col("date").cast("timestamp_ntz") + F.expr(f"INTERVAL {lag}"))


def us_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Observed federal holidays of the years first to last."""
    y = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    day = lambda m, d: F.make_date("y", F.lit(m), F.lit(d))
    nth = lambda m, name, n: F.date_add(F.next_day(F.date_sub(day(m, 1), 1), name), 7 * (n - 1))
    fixed = [day(1, 1), day(7, 4), day(11, 11), day(12, 25), F.when(F.col("y") >= 2021, day(6, 19))]
    observed = [F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d) for d in fixed]
    moving = [nth(1, "Mon", 3), nth(2, "Mon", 3), F.date_sub(F.next_day(day(5, 31), "Mon"), 7), nth(9, "Mon", 1), nth(10, "Mon", 2), nth(11, "Thu", 4)]
    return y.select(F.explode(F.array(*observed, *moving)).alias("date")).filter("date IS NOT NULL").distinct()


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(date, n): numbered US business days."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS date").filter(F.weekday("date") < 5)
    free = us_holidays(spark, int(start[:4]) - 1, int(end[:4]) + 1)
    return days.join(F.broadcast(free), "date", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("date")))


def nfp_date(month_start: Column) -> Column:
    """The first Friday of a month."""
    return F.next_day(F.date_sub(month_start, 1), "Fri")


def rule_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(time, name, currency, importance, source, approximate): payrolls at 08:30 New York, by rule."""
    months = spark.sql(f"SELECT explode(sequence(trunc(DATE '{start}', 'MM'), DATE '{end}', INTERVAL 1 MONTH)) AS m")
    at = F.to_utc_timestamp(nfp_date(F.col("m")).cast("timestamp") + F.expr("INTERVAL '08:30' HOUR TO MINUTE"), "America/New_York").cast("timestamp_ntz")
    rows = months.select(at.alias("time"), F.lit("NFP").alias("name"), F.lit("USD").alias("currency"), F.lit(3).cast("long").alias("importance"), F.lit("rule").alias("source"), F.lit(True).alias("approximate"))
    return rows.filter((F.col("time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def merge_calendars(*frames: DataFrame) -> DataFrame:
    """All events; of equal (time, name) the first frame's stays."""
    out = None
    for k, f in enumerate(frames):
        one = f.withColumn("__k", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    cols = [c for c in out.columns if c != "__k"]
    return out.groupBy("time", "name").agg(F.min_by(F.struct(*cols), "__k").alias("r")).select("r.*")


def load_calendar_csv(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """time, name[, currency, importance]: importance by number (1 to 3) or word."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    word = F.lower(F.trim("importance")) if "importance" in raw.columns else F.lit("high")
    level = F.when(word == "low", 1).when(F.startswith(word, F.lit("med")), 2).when(word == "high", 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(3), F.expr("try_cast(importance AS INT)") if "importance" in raw.columns else F.lit(3))))
    currency = F.coalesce(F.col("currency"), F.lit("USD")) if "currency" in raw.columns else F.lit("USD")
    return raw.select(F.to_utc_timestamp(F.to_timestamp("time"), tz).cast("timestamp_ntz").alias("time"), F.trim("name").alias("name"), currency.alias("currency"), level.cast("long").alias("importance")).filter("time IS NOT NULL")


def classify_event(name: Column) -> Column:
    """Which of NFP, CPI and FOMC an event's name mentions, else OTHER."""
    up = F.upper(name)
    has = lambda *w: F.greatest(*[F.contains(up, F.lit(x)) for x in w]) if len(w) > 1 else F.contains(up, F.lit(w[0]))
    return F.when(has("NFP", "NONFARM", "NON-FARM"), "NFP").when(has("CPI", "CONSUMER PRICE"), "CPI").when(has("FOMC", "FED FUNDS"), "FOMC").otherwise("OTHER")


def published(frame: DataFrame, now: str) -> DataFrame:
    """The rows that were available by then; provisional ones go."""
    return frame.filter(F.col("available_at") <= F.lit(now).cast("timestamp_ntz"))


def lagged(dates: DataFrame, lag_days: int, at: str = "21 hours 30 minutes", *, date: str = "date", start: str | None = None, end: str | None = None) -> DataFrame:
    """dates with available_at: at a time of day, so many US business days later (0: the same or the one before)."""
    spark = dates.sparkSession
    first, last = dates.agg(F.min(date), F.max(date)).head()
    days = business_days(spark, start or str(first - dt.timedelta(days=10)), end or str(last + dt.timedelta(days=3 * lag_days + 20)))
    every = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("__d"))
    known = every.join(days.withColumnRenamed("date", "__b"), F.col("__d") == F.col("__b"), "left")
    # the number of the day, or of the last business day before it
    rolled = known.select("__d", F.last("n", ignorenulls=True).over(Window.orderBy("__d")).alias("__n"))
    target = rolled.join(days.select(F.col("date").alias("__to"), (F.col("n") - lag_days).alias("__n")), "__n").select("__d", "__to")
    out = dates.join(F.broadcast(target), F.col(date) == F.col("__d"), "left")
    return out.withColumn("available_at", F.col("__to").cast("timestamp_ntz") + F.expr(f"INTERVAL {at}")).drop("__d", "__to")


def save_macro(frame: DataFrame, path: str) -> None:
    """All series in one table, a folder a name."""
    frame.write.mode("overwrite").partitionBy("name").parquet(path)


def load_macro(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("name", "date", "value", "available_at")
