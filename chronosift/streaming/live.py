"""A live loop over closed bars: each micro-batch decides, settles a paper account and is stored once.

State lies in Parquet tables under one folder, one part a batch: bars, decisions and account. A batch that is replayed
after a failure overwrites its own parts, so nothing is executed twice. A halt is a row of its own and holds
until it is cleared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronosift.operators.execution import target_lots_pnl
from chronosift.operators.rolling import series
from chronosift.plans.runs import RunConfig, forecasts
from chronosift.streaming.bars import run_available

BARS = "series_id long, time timestamp_ntz, open double, high double, low double, close double, volume double, spread double, available_at timestamp_ntz"


@dataclass(frozen=True)
class Live:
    """What a live loop needs: a folder, the fitted weights (strategy, weight, fdm) and bounds."""

    path: str
    config: RunConfig
    weights: tuple[tuple[str, float], ...]
    fdm: float = 1.0
    lookback: str = "60 days"
    max_age: str = "2 hours"
    max_drawdown: float = 0.3
    equity: float = 100_000.0


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table of batches, or none before the first."""
    from pyspark.errors import AnalysisException

    try:
        return (spark.read.schema(schema + ", batch long") if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def _store(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def decide(bars: DataFrame, live: Live) -> DataFrame:
    """(series_id, time, combined, <rules>, position, pnl, equity): the book of stored bars, as in research."""
    rows = forecasts(bars, live.config)
    total = sum((F.col(n) * w for n, w in live.weights), F.lit(0.0)) * live.fdm
    rows = rows.withColumn("combined", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))).withColumn("lots", F.col("combined") * live.config.lots)
    return target_lots_pnl(rows, "lots", live.config.costs, equity=live.equity)


def step(batch: DataFrame, number: int, live: Live, now: str | None = None) -> None:
    """One micro-batch: stores its bars, then the decisions and the account of the bars that are new."""
    spark = batch.sparkSession
    if halted(spark, live):
        return
    _store(batch.select("series_id", "time", "open", "high", "low", "close", "volume", "spread", "available_at").dropDuplicates(["series_id", "time"]), f"{live.path}/bars", number)
    known = _table(spark, f"{live.path}/bars", BARS)
    newest = known.agg(F.max("time")).head()[0]
    if newest is None:
        return
    recent = known.filter(F.col("time") > F.lit(newest) - F.expr(f"INTERVAL {live.lookback}"))
    first = Window.partitionBy("series_id", "time").orderBy("batch")
    recent = recent.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    book = decide(recent, live)
    at = F.lit(now).cast("timestamp_ntz") if now else F.max("available_at").over(Window.partitionBy("series_id"))
    new = book.filter(F.col("batch") == number).withColumn("stale", F.col("available_at") < at - F.expr(f"INTERVAL {live.max_age}"))
    # a stale bar may only reduce risk
    kept = F.when(F.col("stale") & (F.abs("target") > F.abs("position")), F.col("position")).otherwise(F.col("target"))
    _store(new.select("series_id", "time", "combined", *live.config.rules, "target", kept.alias("approved"), "stale"), f"{live.path}/decisions", number)
    _store(new.select("series_id", "time", "position", "close", "pnl"), f"{live.path}/account", number)
    low = account(spark, live).agg(F.min("drawdown")).head()[0]
    if low is not None and low < -live.max_drawdown:
        spark.createDataFrame([(number, f"drawdown {low:.4f}")], "batch long, reason string").coalesce(1).write.mode("append").json(f"{live.path}/halts")


def account(spark: SparkSession, live: Live) -> DataFrame:
    """(series_id, time, position, close, pnl, equity, drawdown): the paper account so far."""
    rows = _table(spark, f"{live.path}/account")
    if rows is None:
        return spark.createDataFrame([], "series_id long, time timestamp_ntz, position double, close double, pnl double, equity double, drawdown double")
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.drop("batch").withColumn("equity", live.equity + F.sum("pnl").over(w))
    return rows.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(live.equity)) - 1)


def halted(spark: SparkSession, live: Live) -> bool:
    """Whether a halt stands: more halts than resets."""
    halts, resets = (_json(spark, f"{live.path}/{n}") for n in ("halts", "resets"))
    return halts > resets


def _json(spark: SparkSession, path: str) -> int:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("batch long, reason string").json(path).count()
    except AnalysisException:
        return 0


def reset_halt(spark: SparkSession, live: Live, reason: str) -> None:
    if halted(spark, live):
        n = _json(spark, f"{live.path}/halts") - _json(spark, f"{live.path}/resets")
        spark.createDataFrame([(-1, reason)] * n, "batch long, reason string").coalesce(1).write.mode("append").json(f"{live.path}/resets")


def status(spark: SparkSession, live: Live) -> dict:
    """Bars, decisions, newest bar, equity and halt."""
    acc = account(spark, live)
    last = acc.agg(F.count(F.lit(1)).alias("bars"), F.max("time").alias("newest"), F.max_by("equity", "time").alias("equity"), F.min("drawdown").alias("drawdown")).head().asDict()
    return last | {"halted": halted(spark, live)}


def run(bars: DataFrame, live: Live, now: str | None = None) -> StreamingQuery:
    """Processes the closed bars that a stream holds, then ends; call it again for more."""
    return run_available(bars, lambda batch, number: step(batch, number, live, now), f"{live.path}/checkpoint")


def reconcile(decisions: DataFrame, positions: DataFrame, step_lots: float = 0.01) -> DataFrame:
    """(series_id, time, approved, held, order): what is missing to each series' newest decision."""
    newest = decisions.groupBy("series_id").agg(F.max_by(F.struct("time", "approved"), "time").alias("d"))
    both = newest.join(positions.select("series_id", F.col("lots").alias("held")), "series_id", "left")
    missing = F.col("d.approved") - F.coalesce("held", F.lit(0.0))
    whole = F.signum(missing) * F.floor(F.abs(missing) / step_lots + 1e-9) * step_lots
    return both.select("series_id", F.col("d.time").alias("time"), F.col("d.approved").alias("approved"), F.coalesce("held", F.lit(0.0)).alias("held"), whole.alias("order"))
