"""Resampled series for any statistic, and combinatorial cross-validation by any metric.

Draws are hashes of (seed, sample, place), so that they don't depend on how the rows lie, can be repeated in SQL, and are the
same for all series of a length. A statistic is a grouped aggregate over a column: an expression, or a pandas function
registered as one.
"""

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Statistic = Callable[[Column], Column]


def drawn(*parts: Column) -> Column:
    """A number from 0 to below 1: the first 52 bits of a hash of the parts."""
    said = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(said, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def resampled(rows: DataFrame, keys: list[str], *, value: str, order: str, samples: int, block: float, seed: int = 0) -> DataFrame:
    """(keys, sample, i, x): each series drawn anew as often as asked, in circular runs of a mean length of `block`."""
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    placed = good.select(*keys, F.col(value).cast("double").alias("x"), (F.row_number().over(own.orderBy(order)) - 1).alias("i"), F.count(F.lit(1)).over(own).alias("n"))
    each = placed.select(*keys, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    fresh = (F.col("i") == 0) | (drawn(F.lit(f"{seed}r"), F.col("sample"), F.col("i")) < 1.0 / max(block, 1.0))
    start = F.floor(drawn(F.lit(f"{seed}s"), F.col("sample"), F.col("i")) * F.col("n"))
    begun = F.last(F.when(fresh, F.struct(F.col("i").alias("at"), start.alias("start"))), ignorenulls=True).over(Window.partitionBy(*keys, "sample").orderBy("i"))
    at = each.withColumn("__b", begun).select(*keys, "sample", "i", F.pmod(F.col("__b.start") + F.col("i") - F.col("__b.at"), F.col("n")).cast("int").alias("from"))
    return at.join(placed.select(*keys, F.col("i").alias("from"), "x"), [*keys, "from"]).select(*keys, "sample", "i", "x")


def _aggregate(f: Callable[[pd.Series], float]) -> Statistic:
    """A user's function of a pandas series as a grouped aggregate."""

    def run(x: pd.Series) -> float:
        return float(f(x))

    return F.pandas_udf(run, "double")


def _each(rows: DataFrame, keys: list[str], statistics: dict[str, Statistic], functions: dict[str, Callable]) -> DataFrame:
    """(keys, statistic, v) of column x: expressions in one aggregate, pandas functions in another."""
    udf = {s: _aggregate(f) for s, f in functions.items()}
    out = []
    for some in (statistics, udf):
        if some:
            one = rows.groupBy(*keys).agg(*[f(F.col("x")).cast("double").alias(f"__{s}") for s, f in some.items()])
            pairs = [F.struct(F.lit(s).alias("statistic"), F.col(f"__{s}").alias("v")) for s in some]
            out.append(one.select(*keys, F.explode(F.array(*pairs)).alias("s")).select(*keys, "s.*"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def bootstrap(rows: DataFrame, keys: list[str], statistics: dict[str, Statistic], functions: dict[str, Callable] | None = None, *, value: str, order: str, samples: int = 200, block: float = 10.0, alpha: float = 0.05, basic: bool = False, seed: int = 0) -> DataFrame:
    """(keys, statistic, n, estimate, lower, upper, std_error, bias, prob_le_zero) of each series and statistic.

    functions take a pandas series and give a number; a sample is one call. The interval is of percentiles, or with `basic` twice the
    estimate less them. Samples without a finite statistic are left out.
    """
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("x", F.col(value).cast("double"))
    estimate = _each(good, keys, statistics, functions or {}).withColumnRenamed("v", "estimate").join(good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    each = _each(resampled(rows, keys, value=value, order=order, samples=samples, block=block, seed=seed), [*keys, "sample"], statistics, functions or {})
    some = each.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    q = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    over = some.groupBy(*keys, "statistic").agg(q.alias("q"), F.stddev_samp("v").alias("std_error"), F.avg("v").alias("__mean"), F.avg((F.col("v") <= 0).cast("double")).alias("prob_le_zero"))
    both = estimate.join(over, [*keys, "statistic"])
    e, low, high = F.col("estimate"), F.col("q")[0], F.col("q")[1]
    ends = (2 * e - high, 2 * e - low) if basic else (low, high)
    return both.select(*keys, "statistic", "n", "estimate", ends[0].alias("lower"), ends[1].alias("upper"), "std_error", (F.col("__mean") - e).alias("bias"), "prob_le_zero")


def cscv(rows: DataFrame, metric: Statistic, *, blocks: int = 8, config: str = "name", order: str = "date", value: str = "ret") -> DataFrame:
    """(combo, chosen, inside, outside, w, logit): for each half of the blocks of common days, the best configuration by the metric
    within it, and its relative rank without.

    Rows go to every combination (blocks choose blocks / 2 of them), on the one side or the other, so any grouped aggregate
    serves; where sums of blocks will do, risk.pbo moves less.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError("blocks must be even and 2 at least")
    combos = list(itertools.combinations(range(blocks), blocks // 2))
    days = rows.select(order).distinct().select(order, (F.ntile(blocks).over(Window.orderBy(order)) - 1).alias("block"))
    sides = rows.sparkSession.createDataFrame([(b, [b in c for c in combos]) for b in range(blocks)], "block int, sides array<boolean>")
    each = rows.join(days, order).join(F.broadcast(sides), "block").select(config, F.col(value).alias("x"), F.posexplode("sides").alias("combo", "side"))
    scored = each.groupBy("combo", config, "side").agg(metric(F.col("x")).cast("double").alias("v"))
    perf = scored.groupBy("combo", config).agg(F.max(F.when(F.col("side"), F.col("v"))).alias("inside"), F.max(F.when(~F.col("side"), F.col("v"))).alias("outside"))
    return relative_ranks(perf, config)


def relative_ranks(perf: DataFrame, config: str = "name") -> DataFrame:
    """The best configuration inside of each combo, with w = rank outside / (configurations + 1), ties at their mean rank, and its logit."""
    own = Window.partitionBy("combo")
    rank = F.rank().over(own.orderBy("outside")) - 1 + (F.count(F.lit(1)).over(Window.partitionBy("combo", "outside")) + 1) / 2.0
    ranked = perf.withColumn("w", rank / (F.count(F.lit(1)).over(own) + 1)).withColumn("__best", F.row_number().over(own.orderBy(F.desc_nulls_last("inside"), config)))
    return ranked.filter("__best = 1").select("combo", F.col(config).alias("chosen"), "inside", "outside", "w", F.ln(F.col("w") / (1 - F.col("w"))).alias("logit"))


def overfitting(ranks: DataFrame) -> DataFrame:
    """(combos, pbo, median_logit): the share of combinations whose choice isn't above the middle outside."""
    return ranks.agg(F.count(F.lit(1)).alias("combos"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.percentile("logit", F.lit(0.5)).alias("median_logit"))
