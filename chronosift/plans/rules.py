"""Forecast rules in [-1, 1] on bars, and their combination."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions import ewm
from chronosift.functions.scalars import clip, safe_div, tsmom_response
from chronosift.functions.statistics import diversification_multiplier, overlap_correlation
from chronosift.operators import islands, rolling
from chronosift.operators.asof import asof_join
from chronosift.operators.rolling import series

RULES: dict[str, Callable[..., DataFrame]] = {}


def rule(f):
    """Registers a rule: a function of bars that adds a column of its name."""
    RULES[f.__name__] = f
    return f


@rule
def tsmom(bars: DataFrame, horizons=(24, 48, 120), halflife: float = 50) -> DataFrame:
    rows = ewm.with_kernels(bars, {"__v": lambda p: ewm.ewma_vol(p, halflife, 20)})
    n = len(horizons)
    boost = diversification_multiplier(overlap_correlation(list(horizons)), np.full(n, 1 / n))
    parts = [tsmom_response(safe_div(rolling.log_return(F.col("close"), h), F.col("__v") * math.sqrt(h))) for h in horizons]
    total = sum(parts[1:], parts[0]) / n * boost
    return rows.withColumn("tsmom", clip(total, -1, 1)).drop("__v")


@rule
def ema_cross(bars: DataFrame, fast: int = 16, slow: int = 64, halflife: float = 50) -> DataFrame:
    rows = ewm.with_kernels(bars, {"__f": lambda p: ewm.ema(np.log(p["close"]), fast), "__s": lambda p: ewm.ema(np.log(p["close"]), slow), "__v": lambda p: ewm.ewma_vol(p, halflife, 20)})
    return rows.withColumn("ema_cross", clip(safe_div(F.col("__f") - F.col("__s"), F.col("__v") * math.sqrt(slow / 2)), -1, 1)).drop("__f", "__s", "__v")


@rule
def donchian(bars: DataFrame, enter: int = 55, leave: int = 20) -> DataFrame:
    """Long above the highest high of the preceding bars until below the lowest low of fewer, and vice versa."""
    before = lambda c, n, f: F.when(F.count(c).over(series().rowsBetween(-n, -1)) == n, f(c).over(series().rowsBetween(-n, -1)))
    up, down = F.col("close") > before("high", enter, F.max), F.col("close") < before("low", enter, F.min)
    out_long, out_short = F.col("close") < before("low", leave, F.min), F.col("close") > before("high", leave, F.max)
    rows = bars.withColumns({"__a": up, "__b": out_long, "__c": down, "__d": out_short})
    return rows.withColumn("donchian", islands.latch(F.col("__a"), F.col("__b"), F.col("__c"), F.col("__d")).cast("double")).drop("__a", "__b", "__c", "__d")


@rule
def zscore_fade(bars: DataFrame, n: int = 20, enter: float = 2.0) -> DataFrame:
    rows = bars.withColumn("__z", rolling.zscore(F.col("close"), n))
    z = F.col("__z")
    return rows.withColumn("zscore_fade", islands.latch(z <= -enter, z >= 0, z >= enter, z <= 0).cast("double")).drop("__z")


@rule
def bollinger_revert(bars: DataFrame, n: int = 20, k: float = 2.0, stop: float = 3.5) -> DataFrame:
    """Enters when price comes back inside a band, leaves at the middle or beyond the stop."""
    rows = bars.withColumn("__z", F.try_divide(F.col("close") - rolling.mean(F.col("close"), n), rolling.std(F.col("close"), n, ddof=0)))
    rows = rows.withColumn("__y", F.lag("__z").over(series()))
    z, y = F.col("__z"), F.col("__y")
    position = islands.latch((y < -k) & (z >= -k), (z >= 0) | (z < -stop), (y > k) & (z <= k), (z <= 0) | (z > stop))
    return rows.withColumn("bollinger_revert", position.cast("double")).drop("__z", "__y")


@rule
def rsi2(bars: DataFrame, low: float = 10, high: float = 90, trend: int = 100, leave: int = 5) -> DataFrame:
    rows = ewm.with_kernels(bars, {"__r": lambda p: ewm.rsi(p, 2)}).withColumns({"__t": rolling.mean(F.col("close"), trend), "__x": rolling.mean(F.col("close"), leave)})
    c, r, t, x = F.col("close"), F.col("__r"), F.col("__t"), F.col("__x")
    return rows.withColumn("rsi2", islands.latch((r < low) & (c > t), c > x, (r > high) & (c < t), c < x).cast("double")).drop("__r", "__t", "__x")


def _squeeze(p: pd.DataFrame, n: int = 20, least: int = 6, hold: int = 36) -> pd.Series:
    """The sign of momentum after Bollinger bands have left the Keltner channel they were inside of."""
    mid, sd = p["close"].rolling(n).mean(), p["close"].rolling(n).std(ddof=0)
    inside = (2 * sd < 1.5 * ewm.atr(p, n)).to_numpy()
    momentum = (p["close"] - mid).to_numpy()
    out, run, side, age = np.zeros(len(p)), 0, 0.0, 0
    for i in range(len(p)):
        released = run >= least and not inside[i]
        run = run + 1 if inside[i] else 0
        if released and np.isfinite(momentum[i]):
            side, age = float(np.sign(momentum[i])), 0
        elif side:
            age += 1
            if age >= hold or momentum[i] * side < 0:
                side = 0.0
        out[i] = side
    return pd.Series(out)


@rule
def vol_squeeze(bars: DataFrame) -> DataFrame:
    return ewm.with_kernels(bars, {"vol_squeeze": _squeeze})


def steady_gain(level: float = 1.0, slope: float = 0.01, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Gain and covariance of a local linear trend's filter once it has settled, by its Riccati recursion."""
    step, noise, cov = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level, slope]), np.eye(2)
    gain = np.zeros(2)
    for _ in range(rounds):
        ahead = step @ cov @ step.T + noise
        gain = ahead[:, 0] / (ahead[0, 0] + 1.0)
        cov = ahead - np.outer(gain, ahead[0])
    return gain, cov


def _kalman(p: pd.DataFrame, warm: int = 100) -> pd.Series:
    """The slope's t-statistic, halved; noise comes from the first `warm` bars alone, whose forecasts are 0."""
    y = np.log(p["close"]).to_numpy()
    if len(y) <= warm:
        return pd.Series(np.zeros(len(y)))
    scale = 2 * math.sqrt(max(float(np.nanvar(np.diff(y[:warm]), ddof=1)), 1e-12))
    gain, cov = steady_gain()
    level, slope, out = y[0], 0.0, np.zeros(len(y))
    for i, v in enumerate(y):
        level += slope
        miss = v - level
        level, slope = level + gain[0] * miss, slope + gain[1] * miss
        out[i] = slope / (scale * math.sqrt(cov[1, 1]))
    out[:warm] = 0.0
    return pd.Series(np.clip(out, -1, 1))


@rule
def kalman_trend(bars: DataFrame) -> DataFrame:
    return ewm.with_kernels(bars, {"kalman_trend": _kalman})


def combine(forecasts: DataFrame, weights: dict[str, float], fdm: float = 1.0, out: str = "combined") -> DataFrame:
    """clip(fdm * sum of weight * forecast); missing forecasts are 0."""
    parts = [F.coalesce(clip(F.col(k), -1, 1), F.lit(0.0)) * w for k, w in sorted(weights.items())]
    return forecasts.withColumn(out, clip(sum(parts[1:], parts[0]) * fdm, -1, 1))


def contributions(forecasts: DataFrame, weights: DataFrame, names: list[str], fdm: float = 1.0) -> DataFrame:
    """(keys, strategy, contribution) per bar; weights has (fold, strategy, weight), a short table."""
    keys = [c for c in forecasts.columns if c not in names]
    long_ = forecasts.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names]))).alias("strategy", "forecast"))
    return long_.join(F.broadcast(weights), ["fold", "strategy"]).select(*keys, "strategy", (F.col("weight") * F.col("forecast") * fdm).alias("contribution"))


def stream_statistics(forecasts: DataFrame, names: list[str], cost: float = 0.0) -> DataFrame:
    """One row a strategy: mean, deviation and turnover of forecast times next unit-volatility return."""
    rows = forecasts.withColumns({"__next": F.lead("u").over(series())} | {f"__d_{n}": F.abs(F.col(n) - F.coalesce(F.lag(n).over(series()), F.lit(0.0))) for n in names})
    aggs = []
    for n in names:
        x = F.col(n) * F.col("__next") - cost * F.col(f"__d_{n}")
        aggs.append(F.struct(F.lit(n).alias("strategy"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(f"__d_{n}").alias("turnover")).alias(n))
    return rows.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


@rule
def orb(bars: DataFrame, zone: str = "Europe/London", opens: int = 8, hours: int = 2, closes: int = 17) -> DataFrame:
    """Opening range breakout: the first close beyond the local session's opening range holds to its end."""
    local = F.from_utc_timestamp(F.col("time").cast("timestamp"), zone)
    day = Window.partitionBy("series_id", "__day")
    rows = bars.withColumns({"__day": F.to_date(local), "__h": F.hour(local)})
    opening = (F.col("__h") >= opens) & (F.col("__h") < opens + hours)
    so_far = day.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__hi": F.max(F.when(opening, F.col("high"))).over(so_far), "__lo": F.min(F.when(opening, F.col("low"))).over(so_far)})
    live = (F.col("__h") >= opens + hours) & (F.col("__h") < closes)
    side = F.when(live & (F.col("close") > F.col("__hi")), 1.0).when(live & (F.col("close") < F.col("__lo")), -1.0)
    rows = rows.withColumn("__side", side)
    held = F.first("__side", ignorenulls=True).over(so_far)
    # flat from the session's last bar on: its fill would come after the end
    open_ = (F.col("__h") >= opens + hours) & (F.col("__h") < closes - 1)
    return rows.withColumn("orb", F.when(open_, F.coalesce(held, F.lit(0.0))).otherwise(0.0)).drop("__day", "__h", "__hi", "__lo", "__side")


def fit_seasonality(train: DataFrame, *, zone: str = "America/New_York") -> DataFrame:
    """(key, n, mean, shrunk): mean next-bar log return by local hour of the week, shrunk to the grand mean.

    The between-key variance is DerSimonian and Laird's; at most 168 rows.
    """
    nxt = F.ln(F.lead("close").over(series()) / F.lead("open").over(series()))
    rows = train.withColumns({"y": nxt, "key": hour_of_week(F.lead("time").over(series()), zone)}).filter("y IS NOT NULL")
    keys = rows.groupBy("key").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var")).filter("n > 1 AND var > 0")
    whole = Window.partitionBy(F.lit(0))
    w = F.col("n") / F.col("var")
    keys = keys.withColumns({"w": w, "w1": F.sum(w).over(whole), "w2": F.sum(w * w).over(whole), "wm": F.sum(w * F.col("mean")).over(whole), "k": F.count(F.lit(1)).over(whole)})
    keys = keys.withColumn("grand", F.col("wm") / F.col("w1")).withColumn("q", F.sum(F.col("w") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).over(whole))
    tau2 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("w1") - F.col("w2") / F.col("w1")), F.lit(0.0)))
    shrink = F.try_divide(tau2, tau2 + F.col("var") / F.col("n"))
    return keys.select("key", "n", "mean", (F.col("grand") + F.coalesce(shrink, F.lit(0.0)) * (F.col("mean") - F.col("grand"))).alias("shrunk"))


def hour_of_week(time, zone: str):
    local = F.from_utc_timestamp(time.cast("timestamp"), zone)
    return F.weekday(local) * 24 + F.hour(local)


def seasonality(bars: DataFrame, table: DataFrame, *, zone: str = "America/New_York", scale: float = 20.0) -> DataFrame:
    """Adds intraday_seasonality: the fitted table's value for the next hour, in units of recent volatility."""
    rows = ewm.with_kernels(bars, {"__v": lambda p: ewm.ewma_vol(p, 50, 20)}).withColumn("key", hour_of_week(F.col("available_at"), zone))
    out = rows.join(F.broadcast(table.select("key", "shrunk")), "key", "left")
    return out.withColumn("intraday_seasonality", clip(F.coalesce(safe_div(F.col("shrunk"), F.col("__v")), F.lit(0.0)) * scale, -1, 1)).drop("__v", "key", "shrunk")


def macro_factor(bars: DataFrame, macro: DataFrame, signs: dict[str, float], *, days: int = 20, window: int = 60) -> DataFrame:
    """Adds macro_factor: the signed z-scores of macro changes published by each bar, over the root of their number."""
    w = Window.partitionBy("name").orderBy("date")
    long_ = w.rowsBetween(-(window - 1), 0)
    rows = macro.withColumn("c", F.ln(F.col("value") / F.lag("value", days).over(w)))
    z = F.when(F.count("c").over(long_) == window, F.try_divide(F.col("c"), F.stddev_samp("c").over(long_)))
    rows = rows.withColumn("z", z)
    out = bars
    for i, (name, sign) in enumerate(sorted(signs.items())):
        one = rows.filter(F.col("name") == name).select(F.col("available_at").alias("published"), (F.col("z") * sign).alias(f"__z{i}"))
        out = asof_join(out, one, left_time="available_at", right_time="published", columns=[f"__z{i}"])
    zs = [F.col(f"__z{i}") for i in range(len(signs))]
    n = sum((x.isNotNull().cast("int") for x in zs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in zs), F.lit(0.0))
    return out.withColumn("macro_factor", clip(F.when(n > 0, total / F.sqrt(n.cast("double"))).otherwise(0.0) / 2.0, -1, 1)).drop(*[f"__z{i}" for i in range(len(signs))])


def managed(bars: DataFrame, *, base: float = 0.5, span: int = 100) -> DataFrame:
    """Adds managed: a long base that halves while price is below its average and volatility is high, with hysteresis."""
    rows = ewm.with_kernels(bars, {"__e": lambda p: ewm.ema(p["close"], span), "__a": lambda p: ewm.ewma_vol(p, 20, 10), "__b": lambda p: ewm.ewma_vol(p, 200, 50)})
    ratio = safe_div(F.col("__a"), F.col("__b"))
    rows = rows.withColumns({"__on": (F.col("close") < F.col("__e")) & (ratio > 1.2), "__off": (F.col("close") > F.col("__e")) | (ratio < 0.9)})
    risk = islands.latch(F.col("__on"), F.col("__off"), F.lit(False), F.lit(False))
    return rows.withColumn("managed", F.lit(base) * F.when(risk == 1, 0.5).otherwise(1.0)).drop("__e", "__a", "__b", "__on", "__off")


def fear(vix: DataFrame, *, halflife: float = 60, least: int = 40, enter: float = 1.5, leave: float = 0.5) -> DataFrame:
    """(series_id, date, available_at, z, fear): how far log values are above their average before, and a latched size.

    On above `enter`, off below `leave`; half at the entry's level, more for larger moves, 1 at most.
    vix has (series_id, date, available_at, value).
    """

    def z(p: pd.DataFrame) -> np.ndarray:
        x = np.log(p["value"].astype(float))
        before = x.ewm(halflife=halflife, adjust=True, min_periods=least)
        return ((x - before.mean().shift(1)) / before.std().shift(1)).to_numpy()

    rows = ewm.with_kernels(vix.filter("value > 0").select("series_id", "date", "available_at", "value"), {"z": z}, order="date")
    by = Window.partitionBy("series_id").orderBy("date")
    rows = rows.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    on = islands.latch(F.col("z") > enter, F.coalesce(F.col("z") < leave, F.lit(True)), F.lit(False), F.lit(False), by)
    rows = rows.withColumn("__on", on)
    return rows.withColumn("fear", F.when(F.col("__on") > 0, clip(0.5 * (F.col("z") - leave) / (enter - leave), 0, 1)).otherwise(0.0)).drop("__on", "value")


def risk_off(bars: DataFrame, vix: DataFrame, dollar: DataFrame | None = None, *, most: float = 2.0, horizon: int = 5, halflife: float = 60, stale: str = "10 days", **latch: float) -> DataFrame:
    """Adds risk_off: fear() as of each bar, 0 where it is stale or the dollar's momentum is extreme."""
    daily = fear(vix, halflife=halflife, **latch).select(F.col("available_at").alias("__k"), "fear")
    out = asof_join(bars, daily, left_time="available_at", right_time="__k", columns=["fear"], tolerance=stale)
    forecast = F.coalesce(F.col("fear"), F.lit(0.0))
    if dollar is not None:
        sized = ewm.with_kernels(dollar.filter("value > 0"), {"__s": lambda p: np.sqrt((np.log(p["value"]).diff() ** 2).ewm(halflife=halflife, adjust=True, min_periods=40).mean())}, order="date")
        by = Window.partitionBy("series_id").orderBy("date")
        squeeze = safe_div(F.ln(F.col("value") / F.lag("value", horizon).over(by)), F.col("__s") * math.sqrt(horizon))
        out = asof_join(out, sized.select(F.col("available_at").alias("__k"), squeeze.alias("__z")), left_time="available_at", right_time="__k", columns=["__z"], tolerance=stale)
        forecast = F.when(F.coalesce(F.col("__z") > most, F.lit(False)), 0.0).otherwise(forecast)
    return out.withColumn("risk_off", forecast).drop("fear", "__z")


def regime_switch(bars: DataFrame, base: str, train_to: str, *, flat: float = 0.3, full: float = 0.7, states: int = 2) -> DataFrame:
    """Adds regime_switch: a rule's forecast, scaled by how likely the calm state is, by a model of bars before train_to.

    Without enough bars to fit there is no forecast: 0.
    """
    from chronosift.functions.scalars import regime_scale
    from chronosift.plans.models import regimes

    rows = RULES[base](bars)
    observed = bars.withColumn("r", 100 * rolling.log_return(F.col("close")))
    calm = regimes(observed, train_to, states=states)
    scaled = rows.join(calm, ["series_id", "time"], "left")
    sure = F.when(~F.isnan("p_calm"), F.col("p_calm"))
    return scaled.withColumn("regime_switch", F.coalesce(F.col(base) * regime_scale(sure, flat, full), F.lit(0.0))).drop("p_calm", base)


def meta_label(bars: DataFrame, side: str, probability: str, *, dead: float = 0.0) -> DataFrame:
    """Adds meta_label: a rule's side times the bet that the probability of its being right allows; never the other side."""
    from chronosift.functions.scalars import dead_zone
    from chronosift.plans.models import bet_size

    size = F.greatest(F.coalesce(dead_zone(bet_size(F.col(probability)), dead), F.lit(0.0)), F.lit(0.0))
    return bars.withColumn("meta_label", F.signum(F.coalesce(F.col(side), F.lit(0.0))) * size)


def ml_forecast(bars: DataFrame, probability: str, *, dead: float = 0.05, scalar: float = 1.0) -> DataFrame:
    """Adds ml_gbm: a calibrated probability as a forecast, flat in the dead zone."""
    from chronosift.functions.scalars import dead_zone

    f = dead_zone(clip(2 * F.col(probability) - 1, -1, 1), dead) * scalar
    return bars.withColumn("ml_gbm", F.coalesce(clip(f, -1, 1), F.lit(0.0)))


def skill(auc: float, up: float, down: float, uniqueness: float = 1.0) -> float:
    """How many standard errors an area under the curve is above a half, with as many independent labels as are unique."""
    a, b = up * uniqueness, down * uniqueness
    if min(a, b) < 1:
        return 0.0
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    error = math.sqrt(max((auc * (1 - auc) + (a - 1) * (q1 - auc * auc) + (b - 1) * (q2 - auc * auc)) / (a * b), 1e-12))
    return (auc - 0.5) / error
