"""Features across time frames: each frame's own, joined to the base bars once its bar is finished, and how the frames agree.

A larger bar counts from its availability on, so a base bar never sees the rest of a larger bar that it is part of.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.operators.asof import asof_join
from chronosift.operators.resample import resample_bars
from chronosift.operators.rolling import series

OWN = ("volatility", "momentum", "trend", "to_high", "to_low")


def frame_features(bars: DataFrame, *, vol: int = 20, momentum: int = 10, fast: int = 10, slow: int = 30, extremes: int = 20) -> DataFrame:
    """bars with volatility, momentum, trend (1 or -1 by two means), to_high (0 and below) and to_low (0 and above).

    Each is null until its frame is full.
    """
    w = series()
    over = lambda f, n, c: F.when(F.count(c).over(w.rowsBetween(-(n - 1), 0)) == n, f(c).over(w.rowsBetween(-(n - 1), 0)))
    rows = bars.withColumn("__r", F.col("close") / F.lag("close").over(w) - 1)
    means = over(F.avg, fast, "close"), over(F.avg, slow, "close")
    return rows.withColumns({
        "volatility": over(F.stddev_samp, vol, "__r"),
        "momentum": F.col("close") / F.lag("close", momentum).over(w) - 1,
        "trend": F.when(means[1].isNotNull(), F.when(means[0] > means[1], 1.0).otherwise(-1.0)),
        "to_high": F.col("close") / over(F.max, extremes, "high") - 1,
        "to_low": F.col("close") / over(F.min, extremes, "low") - 1,
    }).drop("__r")


def _add(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, parts)


def cross_features(bars: DataFrame, frames: dict[str, str], *, near: float = 0.02, recent: int = 20, long: int = 100) -> DataFrame:
    """bars with <frame>_<feature> of the base ('base') and of larger frames, given by name and width from small to large, and of them all together.

    trend_alignment and trend_divergence are mean and deviation of the trends known, trend_cascade their product; momentum_<a>_<b> the product of
    two neighbours; vol_regime the base's volatility over its mean of `long` bars, vol_spike and vol_compression whether it is above twice, or below half, that
    of `recent`; support and resistance the shares of frames within `near` of their low and high; breakout 1 or -1 where all momenta agree.
    """
    out = frame_features(bars).withColumnsRenamed({c: f"base_{c}" for c in OWN})
    for name, width in frames.items():
        own = frame_features(resample_bars(bars, width)).select("series_id", F.col("available_at").alias("__at"), *[F.col(c).alias(f"{name}_{c}") for c in OWN])
        out = asof_join(out, own, on=["series_id"], left_time="available_at", right_time="__at", columns=[f"{name}_{c}" for c in OWN])
    names = ["base", *frames]
    of = lambda c: [F.col(f"{n}_{c}") for n in names]
    known = lambda cs: _add([c.isNotNull().cast("double") for c in cs])
    total = lambda cs: _add([F.coalesce(c, F.lit(0.0)) for c in cs])
    trends, n = of("trend"), known(of("trend"))
    mean = F.try_divide(total(trends), n)
    spread = F.sqrt(F.try_divide(total([(t - mean) * (t - mean) for t in trends]), n - 1))
    w = series()
    avg = lambda k: F.when(F.count("base_volatility").over(w.rowsBetween(-(k - 1), 0)) == k, F.avg("base_volatility").over(w.rowsBetween(-(k - 1), 0)))
    vol, moves = F.col("base_volatility"), of("momentum")
    share = lambda c, f: F.try_divide(_add([F.coalesce(f(x), F.lit(False)).cast("double") for x in of(c)]), known(of(c)))
    all_ = lambda f: functools.reduce(lambda a, b: a & b, [F.coalesce(f(m), F.lit(False)) for m in moves])
    return out.withColumns({
        "trend_alignment": mean,
        "trend_cascade": F.when(n > 0, functools.reduce(lambda a, b: a * b, [F.coalesce(t, F.lit(1.0)) for t in trends])),
        "trend_divergence": F.when(n > 1, spread),
        **{f"momentum_{b}_{a}": F.col(f"{b}_momentum") * F.col(f"{a}_momentum") for a, b in zip(names, names[1:], strict=False)},
        "vol_regime": F.try_divide(vol, avg(long)),
        "vol_spike": (vol > 2 * avg(recent)).cast("double"),
        "vol_compression": (vol < avg(recent) / 2).cast("double"),
        "support": share("to_low", lambda x: x < near),
        "resistance": share("to_high", lambda x: x > -near),
        "breakout": all_(lambda m: m > 0).cast("double") - all_(lambda m: m < 0).cast("double"),
    })
