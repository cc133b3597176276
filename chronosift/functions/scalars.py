"""Scalar expressions: guarded arithmetic, grids, the normal distribution, finance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null if it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_div(num: Column, den: Column, fill: float | None = None) -> Column:
    """num / den; fill where the quotient isn't a finite number."""
    quotient = finite(F.try_divide(num.cast("double"), den.cast("double")))
    return quotient if fill is None else F.coalesce(quotient, F.lit(float(fill)))


def log_pos(x: Column) -> Column:
    return F.when((x > 0) & (x != float("inf")), F.ln(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def tsmom_response(z: Column) -> Column:
    """z exp(-z^2 / 4) / 0.89: rises, then falls off for extreme moves."""
    return z * F.exp(-z * z / 4.0) / 0.89


def dead_zone(f: Column, width: float) -> Column:
    """0 within the zone, continuous at its edge, +-1 kept."""
    return F.signum(f) * F.greatest(F.abs(f) - width, F.lit(0.0)) / (1.0 - width)


def lot_grid(lots: Column, step: float, smallest: float, largest: float) -> Column:
    """Towards zero onto the grid, with a slack of 1e-9 steps; too small becomes 0."""
    whole = F.floor(F.abs(lots) / step + 1e-9) * step
    return F.when(whole < smallest - 1e-12, 0.0).otherwise(F.signum(lots) * F.least(whole, F.lit(largest)))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Newton's method on the distribution function, from a logistic first guess."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = math.log(p / (1 - p)) / 1.702
    for _ in range(100):
        step = (normal_cdf(x) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def chi2_tail(x: float) -> float:
    """The upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


#: Terms of the series for the normal distribution; enough for |x| up to LARGE.
TERMS, LARGE = 90, 6.5


def normal_cdf_of(x: Column) -> Column:
    """The normal distribution function by its series 1/2 + density * (x + x^3 / 3 + x^5 / 15 + ..)."""
    y = F.greatest(F.least(x, F.lit(LARGE)), F.lit(-LARGE))
    # the innermost term first; a fold, since so deep an expression wouldn't compile
    odd = F.array(*[F.lit(float(2 * k + 1)) for k in range(TERMS, 0, -1)])
    total = F.aggregate(odd, F.lit(1.0), lambda t, d: 1 + y * y / d * t)
    inner = 0.5 + F.exp(-y * y / 2) / math.sqrt(2 * math.pi) * y * total
    return F.when(x >= LARGE, 1.0).when(x <= -LARGE, 0.0).when(x.isNotNull(), inner)


def z_to_forecast(z: Column, scalar: float = 0.5) -> Column:
    return clip(z * scalar, -1, 1)


def regime_scale(p_ok: Column, flat: float, full: float) -> Column:
    """0 up to flat, 1 from full on, linear between."""
    return clip((p_ok - flat) / (full - flat), 0, 1)


def discretise(m: Column, step: float) -> Column:
    """m to the nearest multiple of step, halves to even, within [-1, 1]."""
    return clip(F.bround(m / step) * step, -1, 1)


def carver_scalar(mean_abs: Column, target: float, largest: float = 10.0) -> Column:
    """What brings forecasts of this mean size to the target, capped; 1 for a size of 0."""
    return F.coalesce(F.least(F.try_divide(F.lit(target), mean_abs), F.lit(largest)), F.lit(1.0))


def garch_half_life(alpha: Column, beta: Column) -> Column:
    return F.ln(F.lit(0.5)) / F.ln(alpha + beta)


def garch_level(omega: Column, alpha: Column, beta: Column) -> Column:
    return F.try_divide(omega, 1 - alpha - beta)


def garch_ahead(variance: Column, omega: Column, alpha: Column, beta: Column, steps: int) -> Column:
    """The mean variance of the next `steps` returns, which falls back to its level."""
    level, persistence = garch_level(omega, alpha, beta), alpha + beta
    return level + (variance - level) * F.try_divide(1 - F.pow(persistence, F.lit(steps)), steps * (1 - persistence))


def blend_variance(vols: list[Column], weights: list[float]) -> Column:
    """The root of the weighted mean of the variances that aren't null."""
    got = [F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in zip(vols, weights, strict=True)]
    total = sum((F.coalesce(v * v, F.lit(0.0)) * w for v, w in zip(vols, weights, strict=True)), F.lit(0.0))
    return F.sqrt(F.try_divide(total, sum(got, F.lit(0.0))))
