"""Runs and latches: gaps and islands, signed streaks, forward-filled states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .rolling import series


def with_runs(df: DataFrame, state: str, *, partition: list[str] = ["series_id"], order: str = "time", run: str = "run") -> DataFrame:  # noqa: B006
    """Numbers runs of equal consecutive states (nulls equal nulls)."""
    w = Window.partitionBy(*partition).orderBy(order)
    change = (~F.col(state).eqNullSafe(F.lag(state).over(w))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__change", change.cast("int"))
    return marked.withColumn(run, F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def streaks(df: DataFrame, r: str, out: str = "streak", partition: list[str] = ["series_id"], order: str = "time") -> DataFrame:  # noqa: B006
    """The signed length of the run of same-signed returns; 0 for a zero return, null for none."""
    sign = df.withColumn("__sign", F.signum(r))
    runs = with_runs(sign, "__sign", partition=partition, order=order, run="__run")
    w = Window.partitionBy(*partition, "__run").orderBy(order)
    return runs.withColumn(out, (F.col("__sign") * F.row_number().over(w)).cast("long")).drop("__sign", "__run")


def latch(enter_long: Column, exit_long: Column, enter_short: Column, exit_short: Column, base: WindowSpec | None = None) -> Column:
    """Position -1, 0 or 1: each side holds from entry to exit, entry first; both at once are flat."""
    up_to = (base or series()).rowsBetween(Window.unboundedPreceding, 0)
    held = lambda enter, leave: F.coalesce(F.last(F.when(enter, 1).when(leave, 0), ignorenulls=True).over(up_to), F.lit(0))
    return held(enter_long, exit_long) - held(enter_short, exit_short)


def contiguous_blocks(positions: DataFrame, column: str = "pos") -> DataFrame:
    """(first, last, n) of each run of consecutive integers."""
    w = Window.orderBy(column)
    return positions.select(column, (F.col(column) - F.row_number().over(w)).alias("g")).groupBy("g").agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n")).drop("g")
