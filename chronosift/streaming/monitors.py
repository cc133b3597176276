"""Windows, joins and monitors that work on streams and on tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(ticks: DataFrame, width: str, step: str, *, delay: str | None = None) -> DataFrame:
    """(series_id, start, stop, mean, n): windows that overlap; a stream names its watermark's delay."""
    rows = ticks.withWatermark("time", delay) if delay else ticks
    grouped = rows.groupBy("series_id", F.window("time", width, step).alias("w")).agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n"))
    return grouped.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "mean", "n")


def sessions(ticks: DataFrame, gap: str, *, delay: str | None = None) -> DataFrame:
    """(series_id, start, stop, mean, n): sessions that a quiet gap ends."""
    rows = ticks.withWatermark("time", delay) if delay else ticks
    grouped = rows.groupBy("series_id", F.session_window("time", gap).alias("w")).agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n"))
    return grouped.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "mean", "n")


def with_static(stream: DataFrame, static: DataFrame, key: str, *, time: str = "time", known: str = "available_at", columns: list[str], days: int = 30) -> DataFrame:
    """stream with the newest row of a static table (key, known, columns) that was known at each row's time.

    The table is turned into spans on its side; the stream joins the span that holds its time, by day and key, so it is a plain
    stream-static equi-join. A span is listed under each of its days, `days` at most; older values are stale.
    """
    w = Window.partitionBy(key).orderBy(known)
    spans = static.withColumn("__to", F.lead(known).over(w))
    first = F.to_date(known)
    last = F.least(F.to_date(F.coalesce("__to", F.date_add(first, days).cast("timestamp_ntz"))), F.date_add(first, days))
    listed = spans.select(F.col(key).alias("__k"), F.explode(F.sequence(first, last)).alias("__day"), F.col(known).cast("timestamp").alias("__from"), F.col("__to").cast("timestamp").alias("__to"), *columns)
    at = F.col(time).cast("timestamp")
    inside = (F.col(key) == F.col("__k")) & (F.to_date(at) == F.col("__day")) & (at >= F.col("__from")) & (F.col("__to").isNull() | (at < F.col("__to")))
    return stream.join(listed, inside, "left").drop("__k", "__day", "__from", "__to")


def fresh(bars: DataFrame, now: Column, most: str) -> DataFrame:
    """bars with stale: whether they are older than `most` at `now`; stale ones may only reduce risk."""
    return bars.withColumn("stale", F.col("available_at") < now - F.expr(f"INTERVAL {most}"))


def shortfall(fills: DataFrame, *, extra: float = 0.0) -> DataFrame:
    """fills (time, seq, side, price, mid, spread, lots) with realised and expected: what each cost against its mid."""
    return fills.withColumns({"realised": F.col("side") * (F.col("price") - F.col("mid")), "expected": F.col("spread") / 2 + extra})


def slippage(fills: DataFrame, *, last: int = 50, contract: float = 100.0, least: int = 10, factor: float = 2.0, slack: float = 0.05) -> DataFrame:
    """One row (fills, realised, expected, ratio, excess, alert) of the newest fills."""
    newest = fills.orderBy(F.desc("time"), F.desc("seq")).limit(last)
    out = newest.agg(F.count(F.lit(1)).alias("fills"), F.avg("realised").alias("realised"), F.avg("expected").alias("expected"), F.sum((F.col("realised") - F.col("expected")) * contract * F.col("lots")).alias("excess"))
    alert = (F.col("fills") >= least) & (F.col("realised") > factor * F.col("expected") + slack)
    return out.withColumns({"ratio": F.try_divide("realised", "expected"), "alert": alert}).select("fills", "realised", "expected", "ratio", "excess", "alert")


def bursts(alerts: DataFrame, quiet: str) -> DataFrame:
    """(kind, sent, raised): an alert is sent if none of its kind was raised within the quiet time before."""
    w = Window.partitionBy("kind").orderBy("time")
    before = F.lag("time").over(w)
    sent = before.isNull() | (F.col("time") > before + F.expr(f"INTERVAL {quiet}"))
    return alerts.withColumn("__s", sent.cast("long")).groupBy("kind").agg(F.sum("__s").alias("sent"), F.count(F.lit(1)).alias("raised"))


def heartbeat(beats: DataFrame, now: str, every: float, *, periods: float = 3, grace: float = 30) -> DataFrame:
    """One row (last, age, stale): stale if nothing was heard for so many periods and a grace, in seconds."""
    last = F.max("time")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    return beats.agg(last.alias("last"), age.cast("double").alias("age")).withColumn("stale", F.coalesce(F.col("age") > every * periods + grace, F.lit(True)))


def overlay(quant: Column, desk: Column) -> Column:
    """The desk may shrink the rules' forecast; it never flips or enlarges it. Without a desk's view the rules' stays."""
    up, down = F.least(F.greatest(desk, F.lit(0.0)), quant), F.greatest(F.least(desk, F.lit(0.0)), quant)
    return F.when(desk.isNull(), quant).when(quant > 0, up).when(quant < 0, down).otherwise(0.0)


def bounded(quant: Column, desk: Column, most: float) -> Column:
    """The desk's forecast within [-1, 1], at most so far from the rules'."""
    clipped = F.greatest(F.least(desk, F.lit(1.0)), F.lit(-1.0))
    return F.when(desk.isNull(), quant).otherwise(F.greatest(F.least(clipped, quant + most), quant - most))


def net_lots(positions: DataFrame) -> DataFrame:
    """One row a series: its signed lots, to 8 decimals."""
    return positions.groupBy("series_id").agg(F.round(F.sum(F.col("lots") * F.when(F.col("side") == "buy", 1).otherwise(-1)), 8).alias("lots"))


def quotes(bars: DataFrame, times: DataFrame) -> DataFrame:
    """times (time) with bid and ask: the forming bar's open and spread; null where no bar is open.

    Times join bars by hour, in which a bar of at most an hour begins or ends.
    """
    hours = F.explode(F.array_distinct(F.array(F.date_trunc("hour", "time"), F.date_trunc("hour", "available_at"))))
    b = bars.select(F.col("time").alias("__from"), F.col("available_at").alias("__to"), "open", "spread", hours.alias("__h"))
    inside = (F.date_trunc("hour", F.col("time")) == F.col("__h")) & (F.col("time") >= F.col("__from")) & (F.col("time") < F.col("__to"))
    return times.join(b, inside, "left").select("time", (F.col("open") - F.col("spread") / 2).alias("bid"), (F.col("open") + F.col("spread") / 2).alias("ask"))
