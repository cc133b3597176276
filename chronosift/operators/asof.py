"""As-of joins: for each left row the newest right row that was available by then.

The row is picked, not the value: a null in the newest row stays null. Exact matches count, tolerance
is inclusive, right rows without availability are dropped, and of several rows at one instant the
last by seq wins. Left rows are all kept, also those whose time is null.

One union and one window do it, so the cost is a sort. With `slices`, time is cut into slices as well, so that
one long key is many tasks' work: the newest right row of each slice is carried to all later slices
that lack one by a window over slices alone, and opens each slice (forward: the first row of a slice, to all earlier
ones, and closes them). Without keys slices of SLICE are the default; only the slices are then one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Width of slices where there are no keys.
SLICE = "1 day"


def asof_join(left: DataFrame, right: DataFrame, *, on: list[str] | None = None, left_time: str = "time", right_time: str = "available_at", columns: list[str] | None = None, seq: str | None = None, tolerance: str | None = None, slices: str | None = None, forward: bool = False, strict: bool = False) -> DataFrame:
    """left with `columns` of right (all but keys by default).

    forward: the first right row at or after the left time instead. strict: equal times don't match.
    slices: a width such as '1 day'; by default none with keys, and SLICE without.
    """
    on = on or []
    slices = slices or (None if on else SLICE)
    columns = columns or [c for c in right.columns if c not in on and c not in left.columns]
    carried = F.struct(*[F.col(c) for c in columns], F.col(right_time).alias("__at"))
    order_seq = F.col(seq) if seq else F.lit(0)
    r = right.filter(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("__t"), F.lit(1).alias("__side"), order_seq.cast("long").alias("__seq"), carried.alias("__r"))
    whole = F.struct(*left.columns).alias("__l")
    l = left.select(*on, F.col(left_time).alias("__t"), F.lit(2).alias("__side"), F.lit(None).cast("long").alias("__seq"), whole)  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    # equal times: matching right rows stand on the near side of left rows
    near = F.col("__side") if not (strict ^ forward) else -F.col("__side")
    keys, edge = list(on), F.lit(1)
    carry = None
    if slices:
        us = lambda c: F.unix_micros(c.cast("timestamp"))
        width = us(F.expr(f"TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {slices}")) - us(F.expr("TIMESTAMP '1970-01-01 00:00:00'"))
        slice_ = F.floor(us(F.col("__t")) / width)
        place = F.struct("__t", (-F.col("__seq") if forward else F.col("__seq")).alias("__seq"))
        nearest = r.withColumn("__slice", slice_).groupBy(*on, "__slice").agg((F.min_by if forward else F.max_by)("__r", place).alias("__r"))
        both = both.withColumn("__slice", slice_)
        keys.append("__slice")
    if slices and not on:
        # from the right side alone: what each slice up to the next one with rows (and all beyond the last) takes over
        along = Window.orderBy("__slice")
        if forward:
            span = F.sequence(F.coalesce(F.lag("__slice").over(along), F.col("__slice") - 1), F.col("__slice") - 1)
            end, slot = F.min("__slice") - 1, F.greatest("__slice", "__end")
        else:
            span = F.sequence(F.col("__slice") + 1, F.coalesce(F.lead("__slice").over(along), F.col("__slice") + 1))
            end, slot = F.max("__slice") + 1, F.least("__slice", "__end")
        carry = nearest.withColumn("__span", span).select(F.explode("__span").alias("__slot"), F.col("__r").alias("__c"))
        ends = nearest.agg(end.alias("__end"))
    elif slices:
        present = both.select(*on, "__slice").distinct()
        over = Window.partitionBy(*on).orderBy(F.col("__slice").desc() if forward else F.col("__slice"))
        carried = F.last("__r", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
        more = present.join(nearest, [*on, "__slice"], "left").select(*on, "__slice", carried.alias("__r")).filter("__r IS NOT NULL AND __slice IS NOT NULL")
        both = both.unionByName(more.withColumns({"__side": F.lit(0), "__seq": F.lit(None).cast("long"), "__t": F.lit(None).cast(both.schema["__t"].dataType)}), allowMissingColumns=True)
        # the carried row opens its slice, or closes it
        edge = F.when(F.col("__side") == 0, 2 if forward else 0).otherwise(1)
    by = Window.partitionBy(*keys)
    if forward:
        # from the end on: a frame that ends with the last row would be gone through once a row
        order = by.orderBy(edge.desc(), F.col("__t").desc_nulls_last(), near.desc(), F.col("__seq").asc()).rowsBetween(Window.unboundedPreceding, 0)
        picked = F.last("__r", ignorenulls=True).over(order)
    else:
        order = by.orderBy(edge, F.col("__t").asc_nulls_first(), near, "__seq").rowsBetween(Window.unboundedPreceding, 0)
        picked = F.last("__r", ignorenulls=True).over(order)
    out = both.withColumn("__p", picked).filter("__side = 2")
    if carry is not None:
        slotted = out.crossJoin(F.broadcast(ends)).withColumn("__slot", slot)  # ends is one row
        out = slotted.join(carry, "__slot", "left").withColumn("__p", F.coalesce("__p", "__c"))
    ok = F.col("__t").isNotNull()
    if tolerance:
        gap = (F.col("__p.__at") - F.col("__t")) if forward else (F.col("__t") - F.col("__p.__at"))
        ok = ok & (gap <= F.expr(f"INTERVAL {tolerance}"))
    return out.select("__l.*", *[F.when(ok, F.col("__p").getField(c)).alias(c) for c in columns])
