"""Streaming: bars that close with the watermark, idempotent sinks, monitors.

A bucket's bar is emitted once the watermark has passed its end (append mode), which is the batch
completeness rule; later ticks go to late(). State is a row per open bucket and series.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BAR = "series_id, time, open, high, low, close, volume, available_at"


def stream_bars(ticks: DataFrame, width: str, *, delay: str | None = "0 seconds") -> DataFrame:
    """Closed bars of (series_id, time timestamp, price, seq) ticks; no delay: they have a watermark."""
    at = F.struct("time", "seq")
    grouped = (ticks if delay is None else ticks.withWatermark("time", delay)).groupBy("series_id", F.window("time", width).alias("w"))
    bars = grouped.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("series_id", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", F.col("w.end").alias("available_at"))


def dedupe(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (series_id, seq) once, with state bounded by the watermark."""
    return ticks.withWatermark("time", delay).dropDuplicatesWithinWatermark(["series_id", "seq"])


POSITION = "series_id long, time timestamp, close double, ema double, position double"


def stream_ema_position(bars: DataFrame, span: float = 20.0) -> DataFrame:
    """A recursive rule with state per series: sign(close - ema). Bars older than the state's are skipped."""
    alpha = 2 / (span + 1)

    def step(key, batches, state):
        last, ema = state.get if state.exists else (None, None)
        rows = []
        for pdf in batches:
            rows.append(pdf)
        pdf = pd.concat(rows).sort_values("time", kind="stable")
        out = []
        for b in pdf.itertuples(index=False):
            t = int(pd.Timestamp(b.time).value)
            if last is not None and t <= last:
                continue
            ema = float(b.close) if ema is None else ema + alpha * (b.close - ema)
            last = t
            out.append((key[0], b.time, b.close, ema, float((b.close > ema) - (b.close < ema))))
        state.update((last, ema))
        yield pd.DataFrame(out, columns=["series_id", "time", "close", "ema", "position"])

    return bars.select("series_id", "time", "close").groupBy("series_id").applyInPandasWithState(step, POSITION, "last long, ema double", "append", "NoTimeout")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there in micro-batches, then ends; `sink` must be idempotent by batch id."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def drift(features: DataFrame, reference: DataFrame, columns: list[str], warn: float = 0.1, alert: float = 0.25) -> DataFrame:
    """(column, psi, level) of a batch against reference rows."""
    from chronosift.operators.risk import psi

    out = None
    for c in columns:
        one = psi(reference, features, c).select(F.lit(c).alias("column"), "psi")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("level", F.when(F.col("psi") >= alert, "alert").when(F.col("psi") >= warn, "warn").otherwise("ok"))


def pnl_band(daily: DataFrame, mu: float, sigma: float) -> DataFrame:
    """One row: how many deviations the cumulated log return is from n * mu."""
    return daily.agg(F.count("ret").alias("n"), F.sum(F.log1p("ret")).alias("g")).select("n", F.try_divide(F.col("g") - F.col("n") * mu, sigma * F.sqrt(F.col("n").cast("double"))).alias("z"))
