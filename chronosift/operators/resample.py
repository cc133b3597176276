"""Bars from ticks and coarser bars from finer ones, with the completeness rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ["series_id", "time", "open", "high", "low", "close", "volume", "spread", "available_at"]


def bucket(time: Column, width: str, shift: str = "0 hours") -> Column:
    """The start of the bucket of `width` that holds time; buckets start at midnight plus shift."""
    return F.window(time, width, width, shift).getField("start")


def ticks_to_bars(ticks: DataFrame, width: str, *, shift: str = "0 hours") -> DataFrame:
    """Open and close follow (time, seq), so ties at one instant are settled by seq."""
    at = F.struct("time", "seq")
    rows = ticks.withColumn("bucket", bucket(F.col("time"), width, shift))
    out = rows.groupBy("series_id", "bucket").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.avg("spread").alias("spread"),
    )
    return out.withColumnRenamed("bucket", "time").withColumn("available_at", F.col("time") + F.expr(f"INTERVAL {width}")).select(*BAR_COLUMNS)


def resample_bars(bars: DataFrame, width: str, *, base_width: str = "1 hour", shift: str = "0 hours", keep_incomplete: bool = False) -> DataFrame:
    """Coarser bars. A bar is available no earlier than its bucket's end.

    Incomplete buckets are dropped: the first unless its first base bar opens the bucket, the last
    unless the base data reach its end.
    """
    rows = bars.withColumn("bucket", bucket(F.col("time"), width, shift))
    out = rows.groupBy("series_id", "bucket").agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("volume").alias("volume"),
        F.avg("spread").alias("spread"),
        F.max("available_at").alias("last_available"),
        F.min("time").alias("first_time"),
    )
    end = F.col("bucket") + F.expr(f"INTERVAL {width}")
    out = out.withColumn("available_at", F.greatest(end, F.col("last_available")))
    if not keep_incomplete:
        whole = Window.partitionBy("series_id")
        first, last = F.min("bucket").over(whole), F.max("bucket").over(whole)
        out = out.withColumns({"first": first, "last": last}).filter(
            ((F.col("bucket") > F.col("first")) | (F.col("first_time") == F.col("bucket"))) & ((F.col("bucket") < F.col("last")) | (F.col("last_available") >= end))
        )
    return out.withColumnRenamed("bucket", "time").select(*BAR_COLUMNS)
