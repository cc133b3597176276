"""Walk-forward runs and parameter sweeps: folds and grids are columns, so one job evaluates all."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.statistics import deflated_sharpe, probabilistic_sharpe
from chronosift.operators import splits
from chronosift.operators.execution import Costs, target_lots_pnl
from chronosift.operators.rolling import series

Rule = Callable[..., DataFrame]


def positions(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", (F.row_number().over(series()) - 1).cast("long"))


def out_of_sample(bars: DataFrame, rules: dict[str, Rule], folds: list[dict]) -> DataFrame:
    """(series_id, time, close, fold, <rule>..): causal rules on test bars of each fold."""
    rows = bars
    for f in rules.values():
        rows = f(rows)
    member = splits.folds_frame(bars.sparkSession, folds)
    p = F.col("pos")
    own = positions(rows).join(F.broadcast(member), (p >= F.col("test_from")) & (p < F.col("test_to")))
    return own.select("series_id", "time", "open", "high", "low", "close", "spread", "fold", *rules)


def fold_weights(bars: DataFrame, rules: dict[str, Rule], folds: list[dict], *, floor: float = 0.0) -> DataFrame:
    """(fold, strategy, weight): training Sharpe ratios of forecast * next return, cut at floor; equal if none is above."""
    rows = bars
    for f in rules.values():
        rows = f(rows)
    nxt = F.ln(F.lead("close").over(series()) / F.col("close"))
    rows = positions(rows).withColumn("__next", nxt)
    member = splits.folds_frame(bars.sparkSession, folds)
    p = F.col("pos")
    # the last training bar's return would reach beyond the training slice
    train = rows.join(F.broadcast(member), (p >= F.col("train_from")) & (p < F.col("train_to") - 1))
    x = {n: F.col(n) * F.col("__next") for n in rules}
    sr = train.groupBy("fold").agg(*[F.coalesce(F.try_divide(F.avg(v), F.stddev_samp(v)), F.lit(0.0)).alias(n) for n, v in x.items()])
    raw = sr.select("fold", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.greatest(F.col(n) - floor, F.lit(0.0)) for n in rules]))).alias("strategy", "s"))
    total = F.sum("s").over(Window.partitionBy("fold"))
    return raw.select("fold", "strategy", F.when(total > 0, F.col("s") / total).otherwise(1.0 / len(rules)).alias("weight"))


def walk_forward(bars: DataFrame, rules: dict[str, Rule], folds: list[dict], costs: Costs, *, lots: float = 1.0) -> DataFrame:
    """The stitched out-of-sample book: weights of each fold's training slice on its test bars."""
    oos = out_of_sample(bars, rules, folds)
    w = fold_weights(bars, rules, folds).groupBy("fold").pivot("strategy", list(rules)).agg(F.first("weight"))
    w = w.select("fold", *[F.col(n).alias(f"__w_{n}") for n in rules])
    joined = oos.join(F.broadcast(w), "fold")
    parts = [F.coalesce(F.col(n), F.lit(0.0)) * F.col(f"__w_{n}") for n in rules]
    book = joined.withColumn("combined", sum(parts[1:], parts[0])).withColumn("lots", F.col("combined") * lots)
    return target_lots_pnl(book, "lots", costs).drop(*[f"__w_{n}" for n in rules])


def sharpe_table(book: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bars, sr, skew, kurt): a Sharpe ratio a bar of pnl."""
    return book.groupBy(*keys).agg(F.count("pnl").alias("bars"), F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")).alias("sr"), F.skewness("pnl").alias("skew"), (F.kurtosis("pnl") + 3).alias("kurt"))


#: A rule over rows beside their parameters: (rows, window by point and series) to rows with a column `position`.
PointRule = Callable[..., DataFrame]


def plateau(table: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Adds plateau: the mean sr of the grid's neighbours (by rank on every axis) of each point."""
    out = table
    for k, values in axes.items():
        out = out.withColumn(f"__{k}", F.coalesce(*[F.when(F.col(k) == v, F.lit(i)) for i, v in enumerate(sorted(values))]))
    other = out.select(*[F.col(f"__{k}").alias(f"__o_{k}") for k in axes], F.col("sr").alias("__sr"))
    near, same = F.lit(True), F.lit(True)
    for k in axes:
        near = near & (F.abs(F.col(f"__{k}") - F.col(f"__o_{k}")) <= 1)
        same = same & (F.col(f"__{k}") == F.col(f"__o_{k}"))
    hood = out.join(F.broadcast(other), near & ~same, "left").groupBy(*axes).agg(F.avg("__sr").alias("plateau"))
    return out.drop(*[f"__{k}" for k in axes]).join(hood, list(axes))


def sweep_rows(bars: DataFrame, rule: PointRule, axes: dict[str, list], costs: Costs, *, lots: float = 1.0) -> DataFrame:
    """(axes.., bars, sr, skew, kurt, plateau) of every grid point, in one plan.

    Points are exploded beside the bars, which are read once; everything is partitioned by point and series.
    """
    points = splits.grid(bars.sparkSession, axes)
    base = Window.partitionBy(*axes, "series_id").orderBy("time")
    rows = rule(bars.crossJoin(F.broadcast(points)), base).withColumn("lots", F.col("position") * lots).drop("position")
    return plateau(sharpe_table(target_lots_pnl(rows, "lots", costs, base=base), list(axes)), axes)


def sweep(bars: DataFrame, rule: Rule, name: str, axes: dict[str, list], costs: Costs, *, lots: float = 1.0) -> DataFrame:
    """As sweep_rows, for rules that take their parameters as plain numbers.

    The plan has one branch a point, so this is for small grids; sweep_rows has none.
    """
    points = [r.asDict() for r in splits.grid(bars.sparkSession, axes).collect()]
    scored = [sharpe_table(target_lots_pnl(rule(bars, **p).withColumn("lots", F.col(name) * lots), "lots", costs).withColumns({k: F.lit(v) for k, v in p.items()}), list(axes)) for p in points]
    return plateau(functools.reduce(DataFrame.unionByName, scored), axes)


def deflate(table: DataFrame) -> list[dict]:
    """The rows of a (short) sweep table with psr and dsr; the best first."""
    rows = [r.asDict() for r in table.collect() if r["sr"] is not None]
    srs = [r["sr"] for r in rows]
    mean = sum(srs) / len(srs) if srs else 0.0
    var = sum((s - mean) ** 2 for s in srs) / max(len(srs) - 1, 1)
    for r in rows:
        r["psr"] = probabilistic_sharpe(r["sr"], r["bars"], r["skew"] or 0.0, r["kurt"] or 3.0)
        r["dsr"] = deflated_sharpe(r["sr"], r["bars"], r["skew"] or 0.0, r["kurt"] or 3.0, len(rows), var)
    return sorted(rows, key=lambda r: -r["sr"])
