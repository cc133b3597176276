"""Position sizing as expressions: volatility targets, fixed fractions, drawdown steps, no-trade bands."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.functions.scalars import finite, lot_grid

from .execution import Costs

#: Drawdowns from which on exposure is multiplied by the second number.
STEPS = ((0.10, 0.5), (0.15, 0.25))


@dataclass(frozen=True)
class VolTarget:
    target: float = 0.10
    least_vol: float = 0.03
    max_leverage: float = 3.0
    kelly: float | None = None
    max_lots: float | None = None
    band: float = 0.10
    steps: tuple = STEPS


@dataclass(frozen=True)
class FixedFraction:
    risk: float = 0.01
    stop_atr: float = 2.5
    max_leverage: float = 3.0
    max_lots: float | None = None
    band: float = 0.0
    steps: tuple = STEPS
    periods: float = 252.0


def notional(lots: Column, price: Column, contract: float = 100.0) -> Column:
    return lots * contract * price


def price_pnl(lots: Column, entry: Column, leave: Column, contract: float = 100.0) -> Column:
    return lots * contract * (leave - entry)


def margin(lots: Column, price: Column, contract: float = 100.0, rate: float = 0.05) -> Column:
    return F.abs(notional(lots, price, contract)) * rate


def steps_multiplier(drawdown: Column, steps=STEPS) -> Column:
    """The least multiplier of the steps that the drawdown (of either sign) has reached; 1 without one."""
    deep = F.coalesce(F.abs(finite(drawdown)), F.lit(0.0))
    reached = [F.when(deep >= at - 1e-12, F.lit(float(m))).otherwise(F.lit(1.0)) for at, m in steps]
    return F.least(F.lit(1.0), F.lit(1.0), *reached)


def hold_in_band(target: Column, current: Column, band: float, cap: Column) -> Column:
    """Whether the current lots stay: the change is small, no reversal, to or from flat, and the cap is kept."""
    if band <= 0:
        return F.lit(False)
    same_side = (target * current) > 0
    return same_side & (F.abs(current) <= cap + 1e-12) & (F.abs(target - current) < band * F.greatest(F.abs(target), F.abs(current)))


def _usable(*xs: Column) -> Column:
    ok = F.lit(True)
    for x in xs:
        ok = ok & F.coalesce(finite(x) > 0, F.lit(False))
    return ok


def vol_target(df: DataFrame, s: VolTarget, costs: Costs, *, forecast: str = "forecast", vol: str = "vol", equity: str = "equity", price: str = "price", current: str = "current", drawdown: str = "drawdown") -> DataFrame:
    """Adds raw_notional, capped_notional, multiplier, raw_lots, rounded_lots, kept and lots.

    A forecast that is 0 or not finite, and equity, price or volatility that isn't positive, mean flat.
    """
    c = lambda n: F.col(n).cast("double")
    f = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c(forecast)))
    live = F.coalesce(finite(c(forecast)) != 0, F.lit(False)) & _usable(c(vol), c(equity), c(price))
    used = F.greatest(c(vol), F.lit(s.least_vol))
    limit = s.max_leverage * c(equity)
    if s.kelly is not None:
        limit = F.least(limit, s.kelly * c(equity) / used)
    largest = costs.max_lot if s.max_lots is None else min(s.max_lots, costs.max_lot)
    zero = F.lit(0.0)
    rows = df.withColumns({"raw_notional": F.when(live, f * s.target / used * c(equity)).otherwise(zero), "__limit": F.when(live, limit).otherwise(zero)})
    rows = rows.withColumns({"capped_notional": F.greatest(F.least(F.col("raw_notional"), F.col("__limit")), -F.col("__limit")), "multiplier": F.when(live, steps_multiplier(c(drawdown), s.steps)).otherwise(1.0)})
    per_lot = costs.contract * c(price)
    wanted = F.when(live, F.col("capped_notional") * F.col("multiplier") / per_lot).otherwise(zero)
    rows = rows.withColumns({"raw_lots": F.greatest(F.least(wanted, F.lit(largest)), F.lit(-largest)), "__cap": F.when(live, F.least(F.lit(largest), F.col("__limit") * F.col("multiplier") / per_lot)).otherwise(zero)})
    rows = rows.withColumn("rounded_lots", lot_grid(F.col("raw_lots"), costs.lot_step, costs.lot_step, costs.max_lot))
    held = live & hold_in_band(F.col("rounded_lots"), c(current), s.band, F.col("__cap"))
    rows = rows.withColumn("kept", F.coalesce(held, F.lit(False)))
    lots = F.when(F.col("kept"), lot_grid(c(current), costs.lot_step, costs.lot_step, costs.max_lot)).otherwise(F.col("rounded_lots"))
    return rows.withColumn("lots", lots).drop("__limit", "__cap")


def stop_distance(vol: Column, price: Column, atr: Column, s: FixedFraction) -> Column:
    """stop_atr average true ranges, or as many days' volatility without one; null if neither is usable."""
    day = F.when(_usable(vol, price), price * vol / math.sqrt(s.periods))
    return s.stop_atr * F.when(_usable(atr), atr).otherwise(day)


def fixed_fraction(df: DataFrame, s: FixedFraction, costs: Costs, *, forecast: str = "forecast", vol: str = "vol", equity: str = "equity", price: str = "price", current: str = "current", drawdown: str = "drawdown", atr: str = "atr") -> DataFrame:
    """Adds stop_distance and lots: at the stop |forecast| * risk of equity is lost."""
    c = lambda n: F.col(n).cast("double")
    f = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c(forecast)))
    rows = df.withColumn("stop_distance", stop_distance(c(vol), c(price), c(atr), s))
    live = F.coalesce(finite(c(forecast)) != 0, F.lit(False)) & _usable(c(equity), c(price), F.col("stop_distance"))
    largest = costs.max_lot if s.max_lots is None else min(s.max_lots, costs.max_lot)
    cap = F.least(F.lit(largest), s.max_leverage * c(equity) / (costs.contract * c(price)))
    size = f * s.risk * c(equity) * steps_multiplier(c(drawdown), s.steps) / (F.col("stop_distance") * costs.contract)
    rows = rows.withColumns({"__cap": cap, "__lots": F.when(live, F.greatest(F.least(size, cap), -cap)).otherwise(0.0)})
    rounded = lot_grid(F.col("__lots"), costs.lot_step, costs.lot_step, costs.max_lot)
    rows = rows.withColumn("__r", rounded)
    held = F.coalesce(live & hold_in_band(F.col("__r"), c(current), s.band, F.col("__cap")), F.lit(False))
    return rows.withColumn("lots", F.when(held, lot_grid(c(current), costs.lot_step, costs.lot_step, costs.max_lot)).otherwise(F.col("__r"))).drop("__cap", "__lots", "__r")
