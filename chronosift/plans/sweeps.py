"""Sweeps of a rule's parameters through walk-forward folds, their overfitting, and ledgers of earlier sweeps.

Points and folds are columns: the bars are read once, every grid point is a row beside a bar, and a fold is a range of positions, so
one plan holds all points of all folds. Points are literals, whose number is checked.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators import resamples, splits
from chronosift.operators.execution import Costs, target_lots_pnl
from chronosift.operators.rolling import series
from chronosift.plans.research_runs import PointRule, plateau, sharpe_table

#: Grid points that one sweep may have.
MAX_POINTS = 4096


def point_label(axes: Iterable[str]) -> Column:
    """'a=1,b=2.5' from the axes' columns, in order of their names."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in sorted(axes)])


def with_points(rows: DataFrame, axes: dict[str, list]) -> DataFrame:
    """rows once for every point of the grid, by an explosion of literals."""
    n = 1
    for name, values in axes.items():
        if not values or len(set(values)) != len(values):
            raise ValueError(f"axis {name} needs values, each once")
        n *= len(values)
    if n > MAX_POINTS:
        raise ValueError(f"{n} points are more than {MAX_POINTS}")
    names = list(axes)
    points = [F.struct(*[F.lit(v).alias(a) for a, v in zip(names, p, strict=True)]) for p in itertools.product(*axes.values())]
    return rows.select("*", F.inline(F.array(*points)))


def walk_forward_points(bars: DataFrame, rule: PointRule, axes: dict[str, list], folds: list[dict], costs: Costs, *, lots: float = 1.0, target: float = 0.5, most: float = 4.0) -> DataFrame:
    """(axes.., label, series_id, fold, time, scalar, position, pnl) of the out-of-sample bars of every point.

    A fold's training bars scale the rule's position to the target mean size; on its test bars the scaled position, within 1, is held
    for `lots`. Profit runs on from fold to fold.
    """
    spans = F.broadcast(splits.folds_frame(bars.sparkSession, folds))
    keys = [*axes, "series_id"]
    placed = bars.withColumn("__pos", F.row_number().over(series()) - 1)
    rows = rule(with_points(placed, axes), Window.partitionBy(*keys).orderBy("time")).withColumnRenamed("position", "__raw")
    p = F.col("__pos")
    train = rows.join(spans, (p >= F.col("train_from")) & (p < F.col("train_to")))
    mean = train.groupBy(*keys, "fold").agg(F.avg(F.abs("__raw")).alias("__mean"))
    tests = rows.join(spans, (p >= F.col("test_from")) & (p < F.col("test_to"))).join(mean, [*keys, "fold"])
    scalar = F.when(F.col("__mean") > 0, F.least(target / F.col("__mean"), F.lit(most))).otherwise(0.0)
    held = tests.withColumn("scalar", scalar).withColumn("__lots", F.greatest(F.least(F.col("scalar") * F.col("__raw"), F.lit(1.0)), F.lit(-1.0)) * lots)
    booked = target_lots_pnl(held, "__lots", costs, base=Window.partitionBy(*keys).orderBy("time"))
    return booked.select(*axes, point_label(axes).alias("label"), "series_id", "fold", "time", "scalar", "position", "pnl")


def sweep_table(oos: DataFrame, axes: dict[str, list]) -> DataFrame:
    """(axes.., label, n_folds, bars, sr, skew, kurt, plateau) of every point."""
    scores = plateau(sharpe_table(oos, list(axes)), axes)
    folds = oos.groupBy(*axes, "label").agg(F.count_distinct("fold").alias("n_folds"))
    return folds.join(scores, list(axes))


def period_returns(oos: DataFrame, equity: float, unit: str = "day") -> DataFrame:
    """(label, date, ret): pnl of a point a period over the equity at its start."""
    by = oos.groupBy("label", F.date_trunc(unit, "time").alias("date")).agg(F.sum("pnl").alias("pnl"))
    before = F.coalesce(F.sum("pnl").over(Window.partitionBy("label").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return by.withColumn("__e", equity + before).select("label", "date", F.try_divide(F.col("pnl"), F.col("__e")).alias("ret"))


def complete_periods(returns: DataFrame) -> DataFrame:
    """The periods that have a return of every point."""
    some = returns.filter(F.col("ret").isNotNull())
    all_ = some.agg(F.count_distinct("label").alias("__all"))
    kept = some.groupBy("date").agg(F.count_distinct("label").alias("__n")).join(F.broadcast(all_), F.col("__n") == F.col("__all")).select("date")
    return some.join(kept, "date", "left_semi")


def grid_pbo(returns: DataFrame, blocks: int = 8, metric: resamples.Statistic | None = None) -> DataFrame:
    """resamples.cscv over the complete periods; fewer blocks where there are fewer than twice as many periods, none for a single point."""
    whole = complete_periods(returns)
    size = whole.agg(F.count_distinct("date"), F.count_distinct("label")).head()
    blocks -= blocks % 2
    while blocks >= 2 and size[0] < 2 * blocks:
        blocks -= 2
    sharpe = metric or (lambda x: F.try_divide(F.avg(x), F.stddev_samp(x)))
    if blocks < 2 or size[1] < 2:
        return returns.sparkSession.createDataFrame([], "combo int, chosen string, inside double, outside double, w double, logit double")
    return resamples.cscv(whole, sharpe, blocks=blocks, config="label", order="date", value="ret")


LEDGER = "symbol string, window_start timestamp_ntz, window_end timestamp_ntz, config_hashes array<string>, broken string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a ledger of JSON lines; a line that can't be read has its text in `broken` and nothing else."""
    return spark.read.schema(LEDGER).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def append_ledger(entry: dict, path: str, spark: SparkSession) -> None:
    """Adds one entry as a line of its own file in the ledger's folder."""
    spark.createDataFrame([(json.dumps(entry, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def prior_trials(entries: DataFrame, own: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, window_start, window_end, n_sweeps, n_configs) of each of our windows: earlier sweeps that overlap it, and their configurations
    that aren't ours.

    own has keys, symbol, window_start, window_end and config_hashes. Entries without a symbol count for every symbol; those without a window for
    none. Windows meet on the months they touch, so that no window is held against all entries.
    """
    good = entries.filter("window_start IS NOT NULL AND window_end IS NOT NULL AND window_start <= window_end")
    months = lambda a, b: F.explode(F.sequence(F.date_trunc("month", a), F.date_trunc("month", b), F.expr("INTERVAL 1 MONTH")))
    e = good.select(F.monotonically_increasing_id().alias("__e"), F.col("symbol").alias("__s"), F.col("window_start").alias("__a"), F.col("window_end").alias("__b"), F.col("config_hashes").alias("__h"))
    names = [*keys, "symbol", "window_start", "window_end"]
    mine = own.withColumn("__m", months("window_start", "window_end"))
    meet = mine.join(e.withColumn("__m", months("__a", "__b")), "__m")
    both = meet.filter((F.col("__s").isNull() | (F.col("__s") == F.col("symbol"))) & (F.col("__a") <= F.col("window_end")) & (F.col("__b") >= F.col("window_start")))
    # of the months that both touch only the first counts
    first = both.filter(F.col("__m") == F.date_trunc("month", F.greatest("__a", "window_start")))
    each = first.select(*names, "config_hashes", "__e", F.explode_outer(F.array_except(F.coalesce("__h", F.array().cast("array<string>")), F.coalesce("config_hashes", F.array().cast("array<string>")))).alias("__c"))
    counts = each.groupBy(*names).agg(F.count_distinct("__e").alias("n_sweeps"), F.count_distinct("__c").alias("n_configs"))
    return own.select(*names).join(counts, names, "left").na.fill(0, ["n_sweeps", "n_configs"])
