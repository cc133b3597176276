"""Risk reports: one row an account, from its equity alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.scalars import normal_cdf_of, normal_quantile


def log_share(n: Column, q: Column) -> Column:
    """n ln q, 0 for n = 0."""
    return F.when(n > 0, n * F.ln(q)).otherwise(0.0)


def kupiec_columns(n: Column, breaches: Column, level: float) -> tuple[Column, Column]:
    """Likelihood ratio and p-value of a number of breaches among n."""
    p, share = 1 - level, breaches / n
    ratio = F.greatest(-2 * ((n - breaches) * math.log(1 - p) + breaches * math.log(p) - log_share(n - breaches, 1 - share) - log_share(breaches, share)), F.lit(0.0))
    return F.when(n > 0, ratio), F.when(n > 0, 2 * normal_cdf_of(-F.sqrt(ratio)))


def risk_report(equity: DataFrame, keys: list[str], *, level: float = 0.95, window: int = 250, least: int = 20, order: str = "date", value: str = "equity", shocks: dict[str, float] | None = None, exposure: str | None = None) -> DataFrame:
    """(keys, periods, last_equity, var_*, es_*, mean, sd, skew, kurt, worst, best, max_drawdown, current_drawdown, tests, breaches, kupiec, kupiec_p, and a column a shock).

    VaR and ES are positive losses at `level`: historical, gaussian, and VaR by Cornish and Fisher. tests counts the periods with `window` returns before them, whose
    quantile is their VaR; breaches those below it. shocks: by name, moves of the price; their column is what the last `exposure` (value
    held, in money) would lose or gain over the last equity. Accounts with fewer than `least` returns have null risk figures.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = own.rowsBetween(-window, -1)
    good = equity.filter(F.col(value).isNotNull() & ~F.isnan(value))
    rows = good.withColumn("r", F.try_divide(F.col(value), F.lag(value).over(own)) - 1).withColumn("dd", 1 - F.try_divide(F.col(value), F.max(value).over(so_far)))
    a = 1 - level
    rows = rows.withColumn("q", F.when(F.count("r").over(before) == window, F.percentile("r", F.lit(a)).over(before)))
    last = lambda c: F.max_by(c, order)
    sums = rows.groupBy(*keys).agg(
        F.count("r").alias("periods"), last(value).alias("last_equity"), F.percentile("r", F.lit(a)).alias("__q"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"),
        F.min("r").alias("worst"), F.max("r").alias("best"), F.max("dd").alias("max_drawdown"), last("dd").alias("current_drawdown"), F.count("q").alias("tests"), F.count_if(F.col("r") < F.col("q")).alias("breaches"), *([last(exposure).alias("__x")] if exposure else []),
    )
    tail = rows.join(sums.select(*keys, "__q"), keys).groupBy(*keys).agg(F.avg(F.when(F.col("r") <= F.col("__q"), F.col("r"))).alias("__tail"))
    z = normal_quantile(a)
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    s, k = F.col("skew"), F.col("kurt") - 3
    bent = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    out = sums.join(tail, keys)
    ratio, p = kupiec_columns(F.col("tests").cast("double"), F.col("breaches").cast("double"), level)
    enough = F.col("periods") >= least
    risk = {
        "var_historical": -F.col("__q"), "es_historical": F.greatest(-F.col("__tail"), -F.col("__q")), "var_gaussian": -(F.col("mean") + z * F.col("sd")), "es_gaussian": -(F.col("mean") - density / a * F.col("sd")),
        "var_cornish_fisher": -(F.col("mean") + bent * F.col("sd")),
    }
    stress = {n: F.col("__x") * x / F.col("last_equity") for n, x in (shocks or {}).items()} if exposure else {}
    out = out.withColumns({n: F.when(enough, c) for n, c in risk.items()} | stress | {"kupiec": ratio, "kupiec_p": p})
    return out.select(*keys, "periods", "last_equity", *risk, "mean", "sd", "skew", "kurt", "worst", "best", "max_drawdown", "current_drawdown", "tests", "breaches", "kupiec", "kupiec_p", *stress)
