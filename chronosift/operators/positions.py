"""Positions and running sums over a whole table without a window that one task holds.

The order is cut into ranges that are columns of the row itself, so each range is a window of its own, and a window over the ranges' totals
carries on from one to the next. Ranges are as many as asked for, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def carried(rows: DataFrame, band: Column, order: list[Column | str], value: Column, name: str, *, own: bool = False) -> DataFrame:
    """rows with the sum of value over all rows before in the order of (band, order), their own included if asked.

    band cuts the order into ranges: it must rise with it. Rows of equal order are summed up in any order.
    """
    w = Window.partitionBy("__band").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    cut = rows.withColumns({"__band": band, "__v": value})
    totals = cut.groupBy("__band").agg(F.sum("__v").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__band", before.alias("__o"))  # a row a range
    within = cut.withColumn("__w", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return within.join(F.broadcast(offsets), "__band").withColumn(name, F.col("__w") + F.col("__o")).drop("__band", "__v", "__w", "__o")


def extreme(rows: DataFrame, band: Column, order: str, value: Column, name: str, *, back: bool = False) -> DataFrame:
    """rows with the greatest value so far in the order of (band, order), or the least one from there on (back); order has no ties."""
    f, pick = (F.min, F.least) if back else (F.max, F.greatest)
    along = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))  # a frame that ends with the last row would be gone through once a row
    cut = rows.withColumns({"__band": band, "__v": value})
    totals = cut.groupBy("__band").agg(f("__v").alias("__t"))
    offsets = totals.select("__band", f("__t").over(Window.orderBy(along("__band")).rowsBetween(Window.unboundedPreceding, -1)).alias("__o"))
    own = f("__v").over(Window.partitionBy("__band").orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__w", own).join(F.broadcast(offsets), "__band").withColumn(name, pick("__w", "__o")).drop("__band", "__v", "__w", "__o")


def bands(rows: DataFrame, key: str, ranges: int = RANGES) -> Column:
    """Which range between approximate quantiles a numeric key is in; nulls are in the first."""
    cuts = sorted(set(rows.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    return F.size(F.filter(edges, lambda e: e <= F.col(key)))


def numbered(rows: DataFrame, key: str, name: str = "pos", ranges: int = RANGES) -> DataFrame:
    """rows with their position (from 0) by a numeric key without nulls; ranges lie between approximate quantiles."""
    return carried(rows, bands(rows, key, ranges), [key], F.lit(1), name).withColumn(name, F.col(name).cast("long"))


def banded(p: Column, ranges: int = RANGES) -> Column:
    """Which of so many equal ranges from 0 to 1 a number is in."""
    return F.greatest(F.least(F.floor(p * ranges), F.lit(ranges - 1)), F.lit(0))


def auc(rows: DataFrame, score: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """One row: the weighted area under the curve of scores from 0 to 1, ties count half. Scores are summed up first, then in ranges."""
    w = F.col(weight) if weight else F.lit(1.0)
    up = F.col(y) > 0
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(up, w).otherwise(0.0)).alias("up"), F.sum(F.when(up, 0.0).otherwise(w)).alias("down"))
    below = carried(by, banded(F.col("s")), ["s"], F.col("down"), "b")
    return below.agg(F.try_divide(F.sum(F.col("up") * (F.col("b") + F.col("down") / 2)), F.sum("up") * F.sum("down")).alias("auc"))
