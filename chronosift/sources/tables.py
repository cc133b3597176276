"""Views of the driver's tables as ticks, bars, macro series, calendar and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.resample import ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("time"), (F.col("value") + 1).alias("price"), F.col("event_id").alias("seq"))


def bars(spark: SparkSession, sf_dir: str, width: str = "1 hour", *, by_series: bool = False, shift: str = "0 hours") -> DataFrame:
    """OHLC bars of all ticks, or of each series; spread is 0.1 to 0.149 by event."""
    rows = ticks(spark, sf_dir).withColumn("spread", 0.1 + 0.001 * (F.col("seq") % 50))
    if not by_series:
        rows = rows.withColumn("series_id", F.lit(0).cast("long"))
    return ticks_to_bars(rows, width, shift=shift)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by priority, shifted to overlap the ticks; published at 21:30."""
    day = F.date_add(F.to_date("o_orderdate"), 9131)
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), day.alias("date")).agg(F.sum("o_totalprice").alias("value"))
    return rows.withColumn("available_at", F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL '21:30:00' HOUR TO SECOND"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("ts").alias("time"), F.col("event_type").alias("name"), (1 + F.col("event_id") % 3).alias("importance"), F.col("event_id").alias("seq"))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("equity"))
