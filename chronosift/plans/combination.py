"""Fitting the weights of several forecast rules from their streams, net of the cost of turnover."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosift.functions.statistics import cap_weights, hrp_weights
from chronosift.operators.execution import Costs
from chronosift.operators.rolling import series

SHRINK, FDM_CAP, CORR_FLOOR = 0.5, 2.5, 0.0


def turnover_cost(costs: Costs, vol: str = "vol"):
    """The cost of a forecast change of 1, in units of a bar's volatility."""
    half = F.greatest(F.col("spread") * costs.spread_mult, F.lit(costs.min_spread)) / 2
    a_fill = half + costs.slip_fixed + costs.slip_range * (F.col("high") - F.col("low")) + costs.commission / costs.contract
    return F.try_divide(a_fill, F.col("close") * F.col(vol))


def streams(rows: DataFrame, names: list[str], costs: Costs | None, vol: str = "vol") -> DataFrame:
    """rows that have a next return and a volatility, with gross_<name>, net_<name> and turn_<name>."""
    nxt = F.try_divide(F.ln(F.lead("close").over(series()) / F.col("close")), F.col(vol))
    own = rows.withColumns({"__next": nxt, "__cost": turnover_cost(costs, vol) if costs else F.lit(0.0)} | {f"turn_{n}": F.coalesce(F.abs(F.col(n) - F.lag(n).over(series())), F.lit(0.0)) for n in names})
    live = own.filter(F.col("__next").isNotNull())
    gross = {f"gross_{n}": F.col(n) * F.col("__next") for n in names}
    return live.withColumns(gross).withColumns({f"net_{n}": F.col(f"gross_{n}") - F.col(f"turn_{n}") * F.coalesce("__cost", F.lit(0.0)) for n in names})


def stream_table(rows: DataFrame, names: list[str], costs: Costs | None, vol: str = "vol") -> DataFrame:
    """(strategy, n, mean, sd, sr, sr_gross, turnover, cost): one aggregate over all rules."""
    aggs = []
    for n in names:
        net, gross = F.col(f"net_{n}"), F.col(f"gross_{n}")
        fields = {"n": F.count(net), "mean": F.avg(net), "sd": F.stddev_samp(net), "sr": F.try_divide(F.avg(net), F.stddev_samp(net)), "sr_gross": F.try_divide(F.avg(gross), F.stddev_samp(gross)), "turnover": F.avg(f"turn_{n}"), "cost": F.avg(gross - net)}
        aggs.append(F.struct(F.lit(n).alias("strategy"), *[c.alias(k) for k, c in fields.items()]))
    return streams(rows, names, costs, vol).agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def _pairs(df: DataFrame, columns: list[str], f) -> np.ndarray:
    """A symmetric matrix of an aggregate of each pair of columns."""
    n = len(columns)
    row = df.agg(*[f(columns[i], columns[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)]).head()
    return np.array([[row[f"p{min(i, j)}_{max(i, j)}"] if row[f"p{min(i, j)}_{max(i, j)}"] is not None else float(i == j) for j in range(n)] for i in range(n)], float)


def raw_weights(method: str, sd: np.ndarray, sr: np.ndarray, cov: np.ndarray, active: np.ndarray, *, shrink: float = SHRINK, unallocated: bool = False) -> np.ndarray:
    """Scores of the rules before the cap; those without variance get 0."""
    out = np.zeros(len(sd))
    if not active.any():
        return np.ones(len(sd))
    inverse = np.where(active, 1 / np.where(active, sd, 1.0), 0.0)
    if method == "equal":
        return active.astype(float)
    if method == "inverse_vol":
        return inverse
    if method == "hrp":
        out[active] = hrp_weights(cov[np.ix_(active, active)])
        return out
    if method != "sharpe_shrink":
        raise ValueError(f"unknown method {method!r}")
    counted = active & (sr > 0) if unallocated else active
    if not counted.any():
        return out
    scored = np.where(counted, np.maximum((1 - shrink) * sr + shrink * sr[counted].mean(), 0) * inverse, 0.0)
    return scored if unallocated or scored.sum() > 0 else inverse


def fit(rows: DataFrame, names: list[str], costs: Costs | None, *, method: str = "sharpe_shrink", largest: float = 0.4, unallocated: bool = False, floor: float = CORR_FLOOR, cap: float = FDM_CAP, vol: str = "vol") -> DataFrame:
    """(strategy, weight, fdm): the driver sees one row of figures a rule and a pair of rules."""
    live = streams(rows, names, costs, vol)
    table = {r["strategy"]: r for r in stream_table(rows, names, costs, vol).collect()}
    sd, sr = (np.array([table[n][k] or 0.0 for n in names]) for k in ("sd", "sr"))
    corr = _pairs(live, names, F.corr)
    moving = np.array([x or 0.0 for x in live.agg(*[F.stddev_pop(n) for n in names]).head()])
    active = (sd > 1e-12) & (moving > 1e-12)
    cov = _pairs(live, [f"net_{n}" for n in names], F.covar_samp) if method == "hrp" else np.eye(len(names))
    raw = raw_weights(method, sd, sr, cov, active, unallocated=unallocated)
    w = np.zeros(len(names))
    if active.any():
        w[active] = cap_weights(raw[active], max(largest, 1 / active.sum()), unallocated=unallocated)
    else:
        w[:] = 1 / len(names)
    held = np.where(active, w, 0.0)
    h = np.maximum(corr, floor)
    np.fill_diagonal(h, 1.0)
    quad = float(held @ h @ held)
    fdm = min(max(held.sum() / np.sqrt(quad), 1.0), cap) if quad > 0 else 1.0
    return rows.sparkSession.createDataFrame([(n, float(x), float(fdm)) for n, x in zip(names, w, strict=True)], "strategy string, weight double, fdm double")


def explain(rows: DataFrame, names: list[str], costs: Costs | None, fitted: DataFrame, *, vol: str = "vol", periods: float = 252.0) -> DataFrame:
    """(strategy, weight, fdm, sharpe, sharpe_gross, turnover, cost, mean_size, mean_corr, unallocated): what a fitted combination rests on.

    Ratios are a year's; mean_size is of the forecast, mean_corr of all pairs of forecasts, unallocated what the weights leave out.
    """
    table = stream_table(rows, names, costs, vol).select("strategy", (F.col("sr") * periods**0.5).alias("sharpe"), (F.col("sr_gross") * periods**0.5).alias("sharpe_gross"), "turnover", "cost")
    live = streams(rows, names, costs, vol)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    mean = sum((F.corr(a, b) for a, b in pairs), F.lit(0.0)) / len(pairs) if pairs else F.lit(None).cast("double")
    sizes = F.array(*[F.struct(F.lit(n).alias("strategy"), F.avg(F.abs(F.col(n))).alias("mean_size")) for n in names])
    beside = live.agg(sizes.alias("s"), mean.alias("mean_corr")).select(F.inline("s"), "mean_corr")
    left = fitted.agg(F.greatest(1 - F.sum("weight"), F.lit(0.0)).alias("unallocated"))
    small = lambda df: F.broadcast(df)  # noqa: E731  # a row a rule
    return fitted.join(small(table), "strategy").join(small(beside), "strategy").withColumn("unallocated", F.lit(left.head()[0]))


def attribution(rows: DataFrame, names: list[str], fitted: DataFrame, limit: float = 1.0) -> DataFrame:
    """rows with combined, the clipped part, and contribution_<name> of each rule: they add up to combined + clipped.

    A null forecast counts as 0. The combined forecast is fdm times the weighted sum, within the limit.
    """
    told = {r["strategy"]: (r["weight"], r["fdm"]) for r in fitted.collect()}  # a row a rule
    parts = {f"contribution_{n}": F.coalesce(F.col(n), F.lit(0.0)) * (told[n][0] * told[n][1]) for n in names}
    whole = rows.withColumns(parts)
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    return whole.withColumn("combined", F.greatest(F.least(total, F.lit(limit)), F.lit(-limit))).withColumn("clipped", total - F.col("combined"))
