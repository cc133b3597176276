"""Rolling statistics with a warm-up guard: null until a frame holds enough values.

All functions return columns over a window of one series in time order. ddof 1 is `_samp`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series() -> WindowSpec:
    """One series in time order."""
    return Window.partitionBy("series_id").orderBy("time")


def frame(n: int, base: WindowSpec | None = None) -> WindowSpec:
    return (base or series()).rowsBetween(-(n - 1), 0)


def guarded(value: Column, x: Column, n: int, least: int | None = None, base: WindowSpec | None = None) -> Column:
    """value where the frame holds `least` (by default n) values of x."""
    return F.when(F.count(x).over(frame(n, base)) >= (least or n), value)


def mean(x: Column, n: int, least: int | None = None, base: WindowSpec | None = None) -> Column:
    return guarded(F.avg(x).over(frame(n, base)), x, n, least, base)


def std(x: Column, n: int, least: int | None = None, base: WindowSpec | None = None, ddof: int = 1) -> Column:
    f = F.stddev_samp if ddof else F.stddev_pop
    return guarded(f(x).over(frame(n, base)), x, n, least, base)


def total(x: Column, n: int, least: int | None = None, base: WindowSpec | None = None) -> Column:
    return guarded(F.sum(x).over(frame(n, base)), x, n, least, base)


def highest(x: Column, n: int, base: WindowSpec | None = None) -> Column:
    return guarded(F.max(x).over(frame(n, base)), x, n, None, base)


def lowest(x: Column, n: int, base: WindowSpec | None = None) -> Column:
    return guarded(F.min(x).over(frame(n, base)), x, n, None, base)


def zscore(x: Column, n: int, least: int | None = None, base: WindowSpec | None = None) -> Column:
    return F.try_divide(x - mean(x, n, least, base), std(x, n, least, base))


def log_return(close: Column, k: int = 1, base: WindowSpec | None = None) -> Column:
    return F.ln(close / F.lag(close, k).over(base or series()))


def correlation(x: Column, y: Column, n: int, base: WindowSpec | None = None) -> Column:
    """Null where a side doesn't vary; pairs with a null count for neither side."""
    both = x.isNotNull() & y.isNotNull()
    a, b, w = F.when(both, x), F.when(both, y), frame(n, base)
    return guarded(F.try_divide(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)), F.when(both, F.lit(1)), n, None, base)


def linreg(y: Column, position: Column, n: int, base: WindowSpec | None = None) -> tuple[Column, Column]:
    """Least-squares slope a bar and R squared; a constant window has no R squared."""
    w = frame(n, base)
    r2 = F.when(F.var_pop(y).over(w) > 0, F.regr_r2(y, position).over(w))
    return guarded(F.regr_slope(y, position).over(w), y, n, None, base), guarded(r2, y, n, None, base)


def true_range(base: WindowSpec | None = None) -> Column:
    before = F.lag("close").over(base or series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def close_to_close_vol(n: int, bars_per_year: float, base: WindowSpec | None = None, r: Column | None = None) -> Column:
    return std(F.col("r") if r is None else r, n, base=base) * math.sqrt(bars_per_year)


def parkinson_vol(n: int, bars_per_year: float, base: WindowSpec | None = None) -> Column:
    x = F.ln(F.col("high") / F.col("low"))
    return F.sqrt(mean(x * x, n, base=base) / (4 * math.log(2)) * bars_per_year)


def garman_klass_vol(n: int, bars_per_year: float, base: WindowSpec | None = None) -> Column:
    hl, co = F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    v = mean(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, n, base=base)
    return F.sqrt(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))) * bars_per_year)


def _rs() -> Column:
    up, down = F.ln(F.col("high") / F.col("open")), F.ln(F.col("low") / F.col("open"))
    co = F.ln(F.col("close") / F.col("open"))
    return F.greatest(up * (up - co) + down * (down - co), F.lit(0.0))


def rogers_satchell_vol(n: int, bars_per_year: float, base: WindowSpec | None = None) -> Column:
    return F.sqrt(mean(_rs(), n, base=base) * bars_per_year)


def yang_zhang_vol(n: int, bars_per_year: float, base: WindowSpec | None = None, gap: Column | None = None) -> Column:
    """gap: ln(open / previous close), a column (windows don't nest)."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    g = F.col("gap") if gap is None else gap
    co = F.ln(F.col("close") / F.col("open"))
    w = frame(n, base)
    v = F.var_samp(g).over(w) + k * F.var_samp(co).over(w) + (1 - k) * F.avg(_rs()).over(w)
    return guarded(F.sqrt(v * bars_per_year), g, n, None, base)


def efficiency_ratio(n: int, change: Column, close: Column, base: WindowSpec | None = None) -> Column:
    """|net move| over path length of n changes; a flat path gives 0. change: close - previous close."""
    net, path = F.abs(close - F.lag(close, n).over(base or series())), F.sum(F.abs(change)).over(frame(n, base))
    return guarded(F.coalesce(F.try_divide(net, path), F.lit(0.0)), change, n, None, base)


def variance_ratio(q: int, window: int, r1: Column, rq: Column, base: WindowSpec | None = None) -> Column:
    w = frame(window, base)
    return guarded(F.try_divide(F.var_samp(rq).over(w), q * F.var_samp(r1).over(w)), rq, window, None, base)


def donchian(n: int, base: WindowSpec | None = None) -> tuple[Column, Column]:
    return highest(F.col("high"), n, base), lowest(F.col("low"), n, base)


def bollinger(n: int, k: float, x: Column, base: WindowSpec | None = None) -> tuple[Column, Column]:
    """%b and width in units of the mean; population deviation; a flat window gives 0 for both."""
    m, s = mean(x, n, base=base), std(x, n, base=base, ddof=0)
    flat = s.isNotNull() & (s == 0)
    return F.when(flat, 0.0).otherwise(F.try_divide(x - m, k * s)), F.when(flat, 0.0).otherwise(F.try_divide(2 * k * s, m))


def stochastic(n: int, base: WindowSpec | None = None) -> Column:
    top, low = donchian(n, base)
    return F.when(top.isNotNull(), F.coalesce(F.try_divide(100 * (F.col("close") - low), top - low), F.lit(50.0)))


def percentile_rank(x: Column, n: int, least: int, base: WindowSpec | None = None) -> Column:
    """Average-rank percentile of the newest value within its frame (for frames that fit a row)."""
    w = frame(n, base)
    seen = F.collect_list(x).over(w)
    below = F.size(F.filter(seen, lambda v: v < x))
    same = F.size(F.filter(seen, lambda v: v == x))
    return guarded(F.when(x.isNotNull(), (below + (same + 1) / 2.0) / F.size(seen)), x, n, least, base)
