"""Overnight financing: fixed swaps or a benchmark rate as of each rollover, and round-trip costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .execution import Costs, rollover_nights

HOUR, TRIPLE = 21, 2


@dataclass(frozen=True)
class Financing:
    """mode: 'rate', 'fixed' or 'none'. Rates are annual fractions."""

    mode: str = "rate"
    markup_long: float = 0.025
    markup_short: float = 0.025
    lease: float = 0.0
    fallback: float = 0.03
    day_count: float = 360.0
    swap_long: float = -40.0
    swap_short: float = 15.0


def rate_curve(source: DataFrame, *, time: str = "available_at", value: str = "value", unit: str = "percent", seq: str | None = None) -> DataFrame:
    """(published, rate): finite rates as fractions, the last of each instant."""
    scale = {"percent": 0.01, "fraction": 1.0, "bps": 0.0001}[unit]
    v = F.col(value).cast("double")
    good = source.filter(F.col(time).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return good.groupBy(F.col(time).alias("published")).agg(F.max_by(v * scale, F.col(seq) if seq else v).alias("rate"))


def annual_rate(lots: Column, benchmark: Column, m: Financing) -> Column:
    """The rate on signed notional: a long pays it with its markup, a short is paid it less its own."""
    return benchmark - m.lease + F.when(lots > 0, m.markup_long).otherwise(-m.markup_short)


def amount(lots: Column, nights: Column, m: Financing, *, price: Column | None = None, rate_nights: Column | None = None, contract: float = 100.0) -> Column:
    """Financing received (negative: paid) for holding lots over nights that are weighted already."""
    if m.mode == "none":
        return F.lit(0.0)
    if m.mode == "fixed":
        return F.when(lots > 0, F.abs(lots) * m.swap_long * nights).when(lots < 0, F.abs(lots) * m.swap_short * nights).otherwise(0.0)
    if price is None:
        raise ValueError("financing by rate needs the price at the rollover")
    rates = nights * m.fallback if rate_nights is None else rate_nights
    side = F.when(lots > 0, m.markup_long).otherwise(-m.markup_short) - m.lease
    return F.when((lots == 0) | (nights == 0), 0.0).otherwise(-lots * contract * price * (rates + side * nights) / m.day_count)


def nightly(lots: Column, price: Column, benchmark: Column, m: Financing, contract: float = 100.0) -> Column:
    return amount(lots, F.lit(1.0), m, price=price, rate_nights=benchmark, contract=contract)


def benchmark_at(rows: DataFrame, curve: DataFrame | None, m: Financing, *, time: str = "time", out: str = "benchmark", slices: str | None = None) -> DataFrame:
    """Adds the rate as of each time, the fallback where there is none yet."""
    if curve is None:
        return rows.withColumn(out, F.lit(m.fallback))
    joined = asof_join(rows, curve.withColumnRenamed("rate", out), left_time=time, right_time="published", columns=[out], slices=slices)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(m.fallback)))


def rollovers(spans: DataFrame, keys: list[str], start: str, stop: str, *, hour: int = HOUR, triple: int = TRIPLE) -> DataFrame:
    """(keys, rollover, weight): every weekday rollover in (start, stop] of each row."""
    shift = F.make_dt_interval(hours=F.lit(hour))
    first, last = F.date_add(F.to_date(F.col(start) - shift), 1), F.to_date(F.col(stop) - shift)
    days = spans.filter(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("__d"))
    weight = F.when(F.weekday("__d") >= 5, 0).when(F.weekday("__d") == triple, 3).otherwise(1)
    return days.select(*keys, (F.col("__d").cast("timestamp_ntz") + shift).alias("rollover"), weight.cast("double").alias("weight")).filter("weight > 0")


def rate_nights(spans: DataFrame, keys: list[str], curve: DataFrame | None, m: Financing, *, start: str = "start", stop: str = "stop", hour: int = HOUR, triple: int = TRIPLE, slices: str | None = None) -> DataFrame:
    """(keys, nights, rate_nights): weights, and weights times the rate as of each rollover.

    Rates are looked up once a rollover, not once a span.
    """
    each = rollovers(spans, keys, start, stop, hour=hour, triple=triple)
    known = benchmark_at(each.select("rollover").distinct(), curve, m, time="rollover", slices=slices)
    sums = each.join(known, "rollover").groupBy(*keys).agg(F.sum("weight").alias("nights"), F.sum(F.col("weight") * F.col("benchmark")).alias("rate_nights"))
    return spans.select(*keys).join(sums, keys, "left").na.fill(0.0, ["nights", "rate_nights"])


def swap_between(spans: DataFrame, keys: list[str], curve: DataFrame | None, m: Financing, *, lots: str = "lots", price: str = "price", contract: float = 100.0, **where) -> DataFrame:
    """spans with nights, rate_nights and swap, at a constant price."""
    sums = rate_nights(spans, keys, curve, m, **where)
    return spans.join(sums, keys).withColumn("swap", amount(F.col(lots), F.col("nights"), m, price=F.col(price), rate_nights=F.col("rate_nights"), contract=contract))


def fixed_swap(lots: Column, start: Column, stop: Column, m: Financing) -> Column:
    """Fixed-mode financing without a join: nights have a closed form."""
    return amount(lots, rollover_nights(start, stop, HOUR, TRIPLE).cast("double"), m)


def round_trip(lots: Column, spread: Column, bar_range: Column, costs: Costs) -> Column:
    """What opening and closing costs, without financing."""
    q = F.abs(lots)
    half = F.greatest(spread * costs.spread_mult, F.lit(costs.min_spread)) / 2
    return 2.0 * ((half + costs.slippage(bar_range, q)) * q * costs.contract + q * costs.commission)


def fill_price(side: Column, mid: Column, spread: Column, bar_range: Column, lots: Column, costs: Costs, *, limit: bool = False) -> Column:
    """mid with half the spread and, but for limit orders, slippage against the order (side 1 buys, -1 sells)."""
    half = F.greatest(spread * costs.spread_mult, F.lit(costs.min_spread)) / 2
    return mid + side * (half if limit else half + costs.slippage(bar_range, F.abs(lots)))
