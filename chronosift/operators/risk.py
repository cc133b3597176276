"""Value at risk, overfitting, adjustments, bootstrap and scenarios as tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.scalars import normal_cdf_of, normal_quantile
from chronosift.operators import positions


def var_es(returns: DataFrame, level: float, ret: str = "ret", method: str = "historical") -> DataFrame:
    """One row: var and es as positive losses."""
    a = 1 - level
    if method == "gaussian":
        z = normal_quantile(a)
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return returns.agg(F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s")).select((-(F.col("m") + z * F.col("s"))).alias("var"), (-(F.col("m") - density / a * F.col("s"))).alias("es"))
    q = returns.agg(F.percentile(ret, F.lit(a))).head()[0]
    q = math.nan if q is None else q
    return returns.agg(F.lit(-q).alias("var"), F.greatest(-F.avg(F.when(F.col(ret) <= q, F.col(ret))), F.lit(-q)).alias("es"))


def rolling_var_breaches(returns: DataFrame, level: float, window: int, ret: str = "ret", order: str = "date") -> DataFrame:
    """One row: days with a full preceding window, and how many fell below its quantile."""
    w = Window.orderBy(order).rowsBetween(-window, -1)
    rows = returns.filter(F.col(ret).isNotNull()).select(ret, F.when(F.count(ret).over(w) == window, F.percentile(ret, F.lit(1 - level)).over(w)).alias("q"))
    return rows.filter("q IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ret) < F.col("q")).alias("breaches"))


def _stepped(tests: DataFrame, p: str) -> tuple[DataFrame, Column]:
    """(p, __n, __k, __m, __band), a row a distinct p: its tests, those up to it, and all; and the band that it is in, which rises with p.

    Equal p-values have equal adjusted ones (the last of them decides a minimum from there on, the first a maximum up to there), so that
    distinct values stand for all tests and no order among equal ones is needed.
    """
    by = tests.groupBy(p).agg(F.count(F.lit(1)).alias("__n"))
    band = positions.bands(by, p)
    whole = F.broadcast(by.agg(F.sum("__n").alias("__m")))  # one row
    return positions.carried(by, band, [p], F.col("__n"), "__k", own=True).crossJoin(whole), band


def _back(tests: DataFrame, steps: DataFrame, p: str, new: dict[str, Column]) -> DataFrame:
    """tests with columns of their p's step."""
    found = steps.select(F.col(p).alias("__p"), *[c.alias(n) for n, c in new.items()])
    return tests.join(found, F.col(p).eqNullSafe(F.col("__p")), "left").drop("__p")


def adjust_pvalues(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds bonferroni, holm (running maximum) and bh (reverse running minimum)."""
    steps, band = _stepped(tests, p)
    m, k, x = F.col("__m"), F.col("__k"), F.col(p)
    steps = positions.extreme(steps, band, p, x * (m - (k - F.col("__n"))), "__h")
    steps = positions.extreme(steps, band, p, x * m / k, "__b", back=True)
    cap = lambda c: F.least(c, F.lit(1.0))
    return _back(tests, steps, p, {"bonferroni": cap(x * m), "holm": cap(F.col("__h")), "bh": cap(F.col("__b"))})


def block_sums(perf: DataFrame, blocks: int, *, config: str = "name", order: str = "date", ret: str = "ret") -> DataFrame:
    """(config, block, n, s, ss) over `blocks` runs of equal length of the common days."""
    days = perf.select(order).distinct().select(order, (F.ntile(blocks).over(Window.orderBy(order)) - 1).alias("block"))
    return perf.join(days, order).groupBy(config, "block").agg(F.count(ret).alias("n"), F.sum(ret).alias("s"), F.sum(F.col(ret) * F.col(ret)).alias("ss"))


def pbo(sums: DataFrame, blocks: int, *, config: str = "name") -> DataFrame:
    """For each half of the blocks: the best configuration in it and its relative rank out of it.

    The combinations are a bounded table (blocks choose blocks / 2) that is broadcast.
    """
    spark = sums.sparkSession
    combos = list(itertools.combinations(range(blocks), blocks // 2))
    rows = ",".join(f"({i},{b},{int(b in c)})" for i, c in enumerate(combos) for b in range(blocks))
    member = spark.sql(f"SELECT * FROM VALUES {rows} AS t(combo, block, inside)")

    def sharpe(flag: int) -> Column:
        pick = lambda c: F.sum(F.when(F.col("inside") == flag, F.col(c)))
        n, s, ss = pick("n"), pick("s"), pick("ss")
        return F.try_divide(s / n, F.sqrt((ss - s * s / n) / (n - 1)))

    scores = sums.join(F.broadcast(member), "block").groupBy("combo", config).agg(sharpe(1).alias("is_sr"), sharpe(0).alias("oos_sr"))
    w = Window.partitionBy("combo")
    below = F.rank().over(w.orderBy("oos_sr")) - 1
    same = F.count(F.lit(1)).over(Window.partitionBy("combo", "oos_sr"))
    ranked = scores.withColumns({"w": (below + (same + 1) / 2.0) / (F.count(F.lit(1)).over(w) + 1), "best": F.row_number().over(w.orderBy(F.desc("is_sr"), config))})
    return ranked.filter("best = 1").select("combo", F.col(config).alias("chosen"), "is_sr", "oos_sr", "w", F.ln(F.col("w") / (1 - F.col("w"))).alias("logit"))


def _drawn(returns: DataFrame, n_boot: int, mean_block: float, seed: int, ret: str, order: str) -> DataFrame:
    """(boot, t, x): stationary bootstrap samples. Draws are hashes of (seed, boot, place), whatever the layout.

    The (daily) history is numbered by one window; samples are as many rows as boots times days, by a range and a join.
    """
    rows = returns.filter(F.col(ret).isNotNull())
    n = rows.count()
    numbered = rows.select((F.row_number().over(Window.orderBy(order)) - 1).alias("i"), F.col(ret).alias("x"))
    spark = returns.sparkSession
    grid = spark.range(n_boot * n).select((F.col("id") / n).cast("long").alias("boot"), (F.col("id") % n).alias("t"))
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "boot", "t"), 11) / float(1 << 53)
    starts = grid.withColumn("start", F.when((F.col("t") == 0) | (unit(1) < 1 / mean_block), F.floor(unit(2) * n) - F.col("t")))
    w = Window.partitionBy("boot").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    drawn = starts.select("boot", "t", F.pmod(F.last("start", ignorenulls=True).over(w) + F.col("t"), F.lit(n)).alias("i"))
    return drawn.join(numbered, "i").select("boot", "t", "x")


def bootstrap_means(returns: DataFrame, n_boot: int, mean_block: float, seed: int = 0, ret: str = "ret", order: str = "date") -> DataFrame:
    """(boot, mean, std) of stationary bootstrap samples."""
    return bootstrap(returns, {"mean": F.avg("x"), "std": F.stddev_samp("x")}, n_boot, mean_block, seed, ret, order)


def simulate_paths(returns: DataFrame, n_paths: int, horizon: int, mean_block: float, seed: int = 0, ret: str = "ret", order: str = "date") -> DataFrame:
    """(path, day, equity) of block-bootstrapped compounded returns."""
    rows = returns.filter(F.col(ret).isNotNull())
    n = rows.count()
    numbered = rows.select((F.row_number().over(Window.orderBy(order)) - 1).alias("i"), F.log1p(ret).alias("g"))
    grid = returns.sparkSession.range(n_paths * horizon).select((F.col("id") / horizon).cast("long").alias("path"), (F.col("id") % horizon).alias("day"))
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "path", "day"), 11) / float(1 << 53)
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when((F.col("day") == 0) | (unit(1) < 1 / mean_block), F.floor(unit(2) * n) - F.col("day"))
    drawn = grid.withColumn("start", start).select("path", "day", F.pmod(F.last("start", ignorenulls=True).over(w) + F.col("day"), F.lit(n)).alias("i"))
    return drawn.join(numbered, "i").select("path", "day", F.exp(F.sum("g").over(w)).alias("equity"))


def path_metrics(paths: DataFrame) -> DataFrame:
    """(path, final, max_drawdown)."""
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = paths.withColumn("dd", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)) - 1)
    return d.groupBy("path").agg(F.max_by("equity", "day").alias("final"), F.min("dd").alias("max_drawdown"))


def fan_bands(paths: DataFrame, quantiles: list[float]) -> DataFrame:
    q = F.percentile("equity", F.array(*[F.lit(x) for x in quantiles]))
    return paths.groupBy("day").agg(q.alias("q")).select("day", *[F.col("q")[i].alias(f"q{round(100 * x)}") for i, x in enumerate(quantiles)])


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of a column; bin edges are quantiles of the expected rows."""
    edges = sorted(set(expected.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).head()[0] or []))
    at = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda n, e: n + (F.col(column) >= e).cast("int"))
    share = lambda df, name: df.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias(name))
    both = expected.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin")).join(share(expected, "e"), "bin", "left").join(share(actual, "a"), "bin", "left").na.fill(0)
    tot = both.select("bin", *[F.greatest(F.col(c) / F.sum(c).over(Window.partitionBy(F.lit(0))), F.lit(eps)).alias(c) for c in ("e", "a")])
    norm = tot.select(*[(F.col(c) / F.sum(c).over(Window.partitionBy(F.lit(0)))).alias(c) for c in ("e", "a")])
    return norm.agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def gap_shocks(positions: DataFrame, shocks: list[float], *, contract: float = 100.0) -> DataFrame:
    """Positions (lots, price, equity) times a bounded list of price gaps."""
    s = positions.withColumn("shock", F.explode(F.array(*[F.lit(x) for x in shocks])))
    pnl = F.col("lots") * contract * F.col("price") * F.col("shock")
    return s.withColumn("pnl", pnl).withColumn("equity_after", F.col("equity") + F.col("pnl"))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + .. + 1/m, by its expansion from 64 on."""
    n = m.cast("double")
    far = F.ln(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * F.pow(n, F.lit(4.0))) - 1 / (252 * F.pow(n, F.lit(6.0)))
    return F.when(m < 64, F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k)).otherwise(far)


def more_adjusted(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds sidak, and bhy (Benjamini and Yekutieli under any dependence)."""
    steps, band = _stepped(tests, p)
    m, x = F.col("__m"), F.col(p)
    steps = positions.extreme(steps, band, p, x * m * harmonic(m) / F.col("__k"), "__b", back=True)
    return _back(tests, steps, p, {"sidak": 1 - F.pow(1 - x, m.cast("double")), "bhy": F.least(F.col("__b"), F.lit(1.0))})


def moments(rows: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """(keys, n, mean, sd, sr, skew, kurt): sample deviation, biased skewness and kurtosis (3 for a normal)."""
    return rows.filter(F.col(ret).isNotNull()).groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.try_divide(F.avg(ret), F.stddev_samp(ret)).alias("sr"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt"))


def sharpe_table(stats: DataFrame, *, periods: float = 252.0, alpha: float = 0.05, prob: float = 0.95) -> DataFrame:
    """moments() with standard error, probabilistic ratio, p-value, interval and least track record of each row."""
    sr = F.col("sr")
    spread = F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(0.0))
    rows = stats.withColumns({"se": F.sqrt(spread / (F.col("n") - 1)), "sharpe": sr * math.sqrt(periods)})
    z, t = normal_quantile(1 - alpha / 2), normal_quantile(prob)
    return rows.withColumns({
        "psr": normal_cdf_of(sr / F.col("se")), "p_value": normal_cdf_of(-sr / F.col("se")), "low": (sr - z * F.col("se")) * math.sqrt(periods), "high": (sr + z * F.col("se")) * math.sqrt(periods),
        "min_trl": F.when(sr > 0, 1 + spread * F.pow(t / sr, F.lit(2.0))),
    })


def deflated(stats: DataFrame) -> DataFrame:
    """moments() with dsr: the chance that a ratio beats the best of as many trials without skill as there are rows."""
    euler = 0.5772156649015329
    n, var = stats.agg(F.count("sr"), F.var_samp("sr")).head()
    best = math.sqrt(var or 0.0) * ((1 - euler) * normal_quantile(1 - 1 / n) + euler * normal_quantile(1 - 1 / (n * math.e))) if n > 1 else 0.0
    sr = F.col("sr")
    se = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(0.0)) / (F.col("n") - 1))
    return stats.withColumns({"best_by_chance": F.lit(best), "dsr": normal_cdf_of((sr - best) / se)})


def cornish_fisher_table(stats: DataFrame, level: float = 0.95, horizon: int = 1) -> DataFrame:
    """(.., var, es) from n, mean, sd and bias-corrected skew and excess, over a horizon of independent periods."""
    a = 1 - level
    z = normal_quantile(a)
    tail = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / a
    e1, e2, e3 = -tail, 1 - z * tail, -(z * z + 2) * tail
    s, k = F.col("skew") / math.sqrt(horizon), F.col("excess") / horizon
    mu, sd = F.col("mean") * horizon, F.col("sd") * math.sqrt(horizon)
    at = lambda a1, a2, a3: a1 + (a2 - 1) * s / 6 + (a3 - 3 * a1) * k / 24 - (2 * a3 - 5 * a1) * s * s / 36
    var = -(mu + sd * at(z, z * z, z**3))
    return stats.withColumns({"var": var, "es": F.greatest(-(mu + sd * at(e1, e2, e3)), var)})


def position_var(lots: Column, price: Column, vol: Column, *, level: float = 0.99, days: float = 1.0, contract: float = 100.0, periods: float = 252.0) -> tuple[Column, Column]:
    """Gaussian value at risk and expected shortfall of a position, in money, without drift."""
    z = normal_quantile(1 - level)
    sd = vol * math.sqrt(days / periods) * F.abs(lots * contract * price)
    return -z * sd, math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (1 - level) * sd


def stress(positions: DataFrame, scenarios: dict[str, float], *, contract: float = 100.0, spread: float = 0.0) -> DataFrame:
    """positions (lots, price, equity) times named price gaps, with the cost of leaving at a wide spread."""
    named = F.explode(F.create_map(*[F.lit(x) for kv in scenarios.items() for x in kv])).alias("scenario", "shock")
    rows = positions.select("*", named)
    pnl = F.col("lots") * contract * F.col("price") * F.col("shock") - F.abs("lots") * contract * max(spread, 0.0) / 2
    return rows.withColumn("pnl", pnl).withColumns({"share": F.when(F.col("equity") > 0, F.col("pnl") / F.col("equity")), "equity_after": F.col("equity") + F.col("pnl")})


def kupiec_test(counts: DataFrame, level: float) -> DataFrame:
    """counts (n, breaches) with lr and p_value of the proportion of failures."""
    n, k, p = F.col("n").cast("double"), F.col("breaches").cast("double"), 1 - level
    log = lambda count, share: F.when(count > 0, count * F.ln(share)).otherwise(0.0)
    lr = -2 * (log(n - k, F.lit(1 - p)) + log(k, F.lit(p)) - log(n - k, 1 - k / n) - log(k, k / n))
    rows = counts.withColumn("lr", F.greatest(lr, F.lit(0.0)))
    return rows.withColumn("p_value", 2 * normal_cdf_of(-F.sqrt("lr")))


def autocovariances(returns: DataFrame, lags: int, ret: str = "ret", order: str = "date") -> DataFrame:
    """(lag, acov) for lags 0 to `lags`; the lags are columns of one pass over the (daily) rows."""
    w = Window.orderBy(order)
    x = returns.filter(F.col(ret).isNotNull()).select(order, F.col(ret).alias("x"))
    x = x.withColumn("e", F.col("x") - F.avg("x").over(Window.partitionBy(F.lit(0))))
    pairs = x.select(*[(F.col("e") * F.lag("e", k).over(w)).alias(f"k{k}") for k in range(lags + 1)])
    sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(F.sum(f"k{k}"), F.lit(0.0)) for k in range(lags + 1)]).alias("s"))
    return sums.select(F.posexplode(F.transform("s", lambda v: v / F.col("n"))).alias("lag", "acov"))


def block_length(returns: DataFrame, ret: str = "ret", order: str = "date") -> DataFrame:
    """One row (stationary, circular, m_hat, bandwidth): automatic block lengths of both bootstraps.

    The first lag behind which several autocorrelations in a row mean nothing gives the bandwidth of a flat-top window.
    The driver sees one number a lag, of which there are about the root of the rows.
    """
    n = returns.filter(F.col(ret).isNotNull()).count()
    spark = returns.sparkSession
    schema = "stationary double, circular double, m_hat long, bandwidth long"
    if n < 8:
        return spark.createDataFrame([(1.0, 1.0, 0, 0)], schema)
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    most, largest = math.ceil(math.sqrt(n)) + run, math.ceil(min(3 * math.sqrt(n), n / 3))
    lags = min(most + run, n - 1)
    acov = [r["acov"] for r in autocovariances(returns, lags, ret, order).orderBy("lag").collect()]
    if acov[0] <= 0:
        return spark.createDataFrame([(1.0, 1.0, 0, 0)], schema)
    noise = [abs(a / acov[0]) < 2 * math.sqrt(math.log10(n) / n) for a in acov[1:]]
    m_hat = next((m for m in range(lags - run + 1) if all(noise[m : m + run])), most)
    width = min(2 * m_hat, most, lags)
    window = [min(1.0, 2 * (1 - k / width)) for k in range(1, width + 1)]
    level = acov[0] + 2 * sum(w * a for w, a in zip(window, acov[1:], strict=False))
    slope = 2 * sum(w * k * a for k, (w, a) in enumerate(zip(window, acov[1:], strict=False), 1))
    if level <= 0:
        lengths = [n ** (1 / 3)] * 2
    else:
        lengths = [(c * (slope / level) ** 2 * n) ** (1 / 3) for c in (1.0, 1.5)]
    return spark.createDataFrame([(*[float(min(max(b, 1.0), largest)) for b in lengths], m_hat, width)], schema)


def bootstrap(returns: DataFrame, statistics: dict[str, Column], n_boot: int, mean_block: float, seed: int = 0, ret: str = "ret", order: str = "date") -> DataFrame:
    """(boot, each statistic): any aggregates of the column x over stationary bootstrap samples."""
    return _drawn(returns, n_boot, mean_block, seed, ret, order).groupBy("boot").agg(*[c.alias(k) for k, c in statistics.items()])


def bootstrap_interval(samples: DataFrame, name: str, estimate: float, alpha: float = 0.05) -> DataFrame:
    """One row (estimate, se, bias, low, high, basic_low, basic_high, p_below): of one statistic's samples."""
    q = F.percentile(name, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    s = samples.agg(F.lit(estimate).alias("estimate"), F.stddev_samp(name).alias("se"), (F.avg(name) - estimate).alias("bias"), q.alias("q"), F.avg((F.col(name) <= 0).cast("double")).alias("p_below"))
    return s.select("estimate", "se", "bias", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), (2 * estimate - F.col("q")[1]).alias("basic_low"), (2 * estimate - F.col("q")[0]).alias("basic_high"), "p_below")


def path_figures(paths: DataFrame, periods: float = 252.0) -> DataFrame:
    """(path, days, final, cagr, max_drawdown, trough, recovery, underwater) of paths (path, day, equity) that begin at 1.

    trough: the day of the deepest drawdown; recovery: days from it to the next peak as high as before (null: none);
    underwater: the most days on end below an earlier peak.
    """
    w = Window.partitionBy("path").orderBy("day")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("top", F.greatest(F.max("equity").over(so_far), F.lit(1.0)))
    rows = rows.withColumns({"dd": F.col("equity") / F.col("top") - 1, "dry": F.max(F.when(F.col("equity") >= F.col("top"), F.col("day"))).over(so_far)})
    rows = rows.withColumn("wet", F.col("day") - F.coalesce("dry", F.lit(-1)))
    one = rows.groupBy("path").agg(F.count(F.lit(1)).alias("days"), F.max_by("equity", "day").alias("final"), F.min("dd").alias("max_drawdown"), F.min_by("day", F.struct("dd", "day")).alias("trough"), F.min_by("top", F.struct("dd", "day")).alias("__top"), F.max("wet").alias("underwater"))
    back = rows.join(one.select("path", "trough", "__top"), "path").filter("day > trough AND equity >= __top").groupBy("path").agg(F.min("day").alias("__back"))
    out = one.join(back, "path", "left").withColumns({"cagr": F.pow("final", periods / F.col("days")) - 1, "recovery": F.col("__back") - F.col("trough")})
    return out.select("path", "days", "final", "cagr", "max_drawdown", "trough", "recovery", "underwater")


def drawdown_exceedance(figures: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, probability) that a path's drawdown is deeper."""
    return figures.select(F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"), "max_drawdown").groupBy("threshold").agg(F.avg((F.col("max_drawdown") < -F.col("threshold")).cast("double")).alias("probability"))


def risk_of_ruin(paths: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, touches, ends): how many paths ever fall to that share of their start, and how many end there."""
    one = paths.groupBy("path").agg(F.min("equity").alias("low"), F.max_by("equity", "day").alias("final"))
    each = one.select(F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"), "low", "final")
    return each.groupBy("threshold").agg(F.avg((F.col("low") <= F.col("threshold")).cast("double")).alias("touches"), F.avg((F.col("final") <= F.col("threshold")).cast("double")).alias("ends"))


def distribution(figures: DataFrame, columns: list[str], quantiles: list[float]) -> DataFrame:
    """(metric, mean, q..): of path figures."""
    stacked = figures.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(*[F.lit(x) for x in quantiles]))
    return stacked.groupBy("metric").agg(F.avg("v").alias("mean"), q.alias("q")).select("metric", "mean", *[F.col("q")[i].alias(f"q{round(100 * x)}") for i, x in enumerate(quantiles)])


def recovery(figures: DataFrame) -> DataFrame:
    """One row: the share of paths that came back from their deepest drawdown, and how long that took."""
    return figures.agg(F.avg(F.col("recovery").isNotNull().cast("double")).alias("recovered"), F.percentile("recovery", F.lit(0.5)).alias("median_days"), F.max("recovery").cast("long").alias("longest_days"), F.max("underwater").cast("long").alias("longest_underwater"))


def worst_moves(returns: DataFrame, windows: list[int], lots: float, price: float, equity: float, *, order: str = "date", ret: str = "ret", contract: float = 100.0) -> DataFrame:
    """(days, side, move, pnl, share): the worst fall and rise over so many days, applied to a position."""
    w = Window.orderBy(order)
    rows = returns.filter(F.col(ret).isNotNull()).select(order, F.log1p(ret).alias("g"))
    sums = [F.when(F.count("g").over(w.rowsBetween(-(n - 1), 0)) == n, F.exp(F.sum("g").over(w.rowsBetween(-(n - 1), 0))) - 1).alias(f"m{n}") for n in windows]
    one = rows.select(*sums).agg(*[f(f"m{n}").alias(f"{k}{n}") for n in windows for k, f in (("drop", F.min), ("rise", F.max))])
    moves = F.array(*[F.struct(F.lit(n).alias("days"), F.lit(k).alias("side"), F.col(f"{k}{n}").alias("move")) for n in windows for k in ("drop", "rise")])
    pnl = lots * contract * price * F.col("move")
    return one.select(F.explode(moves).alias("x")).select("x.*").withColumns({"pnl": pnl, "share": pnl / equity})
