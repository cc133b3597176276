"""Costs, financing, sizing, risk limits, and two simulators: native and stateful."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.ewm import by_series, spans, whole_series

from .rolling import series


@dataclass(frozen=True)
class Costs:
    contract: float = 100.0
    lot_step: float = 0.01
    max_lot: float = 50.0
    spread_mult: float = 1.0
    min_spread: float = 0.0
    slip_fixed: float = 0.0
    slip_range: float = 0.0
    impact: float = 0.0
    commission: float = 3.5
    swap_long: float = 0.0
    swap_short: float = 0.0

    def slippage(self, bar_range, lots):
        root = F.sqrt(F.abs(lots)) if isinstance(lots, Column) else math.sqrt(abs(lots))
        return self.slip_fixed + self.slip_range * bar_range + self.impact * root


def rollover_nights(start: Column, stop: Column, hour: int = 21, triple: int = 2) -> Column:
    """Nights charged in (start, stop]: one a weekday rollover, three on weekday `triple` (Monday 0), none at weekends.

    Closed form: the weights before a day are 7 a week plus those of the week's days so far.
    """
    def before(t: Column) -> Column:
        # rollovers up to and including t
        days = F.floor((F.unix_micros(t.cast("timestamp")) / 1_000_000 - hour * 3600) / 86400) + 1 + 3  # days since a Monday
        weights = [1 if d != triple else 3 for d in range(5)] + [0, 0]
        sums = [sum(weights[:i]) for i in range(7)]
        return F.floor(days / 7) * sum(weights) + F.element_at(F.array(*[F.lit(s) for s in sums]), (F.pmod(days, F.lit(7)) + 1).cast("int"))

    return (before(stop) - before(start)).cast("long")


def intrabar_exit(position, open_, high, low, stop, target) -> tuple[str | None, float | None]:
    """The protective exit of one bar: a gap through a level fills at the open, a stop goes before a target."""
    if not position:
        return None, None
    long_ = position > 0
    if stop is not None and (open_ <= stop if long_ else open_ >= stop):
        return "stop", open_
    if target is not None and (open_ >= target if long_ else open_ <= target):
        return "target", open_
    if stop is not None and (low <= stop if long_ else high >= stop):
        return "stop", stop
    if target is not None and (high >= target if long_ else low <= target):
        return "target", target
    return None, None


def target_lots_pnl(bars: DataFrame, lots: str, costs: Costs, *, equity: float = 100_000.0, base=None) -> DataFrame:
    """Holds each bar's target (null: the last one) from the next open; a native closed form.

    pnl = held position * move + fill cost; the move from close to open belongs to the old position.
    """
    base = base or series()
    target = F.last(F.col(lots), ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    rows = bars.withColumn("target", F.coalesce(target, F.lit(0.0)))
    rows = rows.withColumns({"position": F.coalesce(F.lag("target").over(base), F.lit(0.0)), "before": F.coalesce(F.lag("target", 2).over(base), F.lit(0.0)), "pc": F.coalesce(F.lag("close").over(base), F.col("open"))})
    traded = F.abs(F.col("position") - F.col("before"))
    half = F.greatest(F.col("spread") * costs.spread_mult, F.lit(costs.min_spread)) / 2
    cost = F.when(traded > 0, traded * costs.contract * (half + costs.slippage(F.col("high") - F.col("low"), traded)) + traded * costs.commission).otherwise(0.0)
    move = costs.contract * (F.col("before") * (F.col("open") - F.col("pc")) + F.col("position") * (F.col("close") - F.col("open")))
    rows = rows.withColumns({"cost": cost, "gross": move}).withColumn("pnl", F.col("gross") - F.col("cost"))
    return rows.withColumn("equity", equity + F.sum("pnl").over(base.rowsBetween(Window.unboundedPreceding, 0))).drop("before", "pc")


def buy_and_hold(bars: DataFrame, lots: float, costs: Costs, *, equity: float = 100_000.0) -> DataFrame:
    return target_lots_pnl(bars.withColumn("lots", F.lit(float(lots))), "lots", costs, equity=equity)


def vol_target_lots(forecast: Column, vol: Column, equity: Column, price: Column, costs: Costs, *, target: float = 0.1, max_leverage: float = 3.0) -> Column:
    """Lots for forecast * target / vol of equity, capped by leverage, on the lot grid."""
    from chronosift.functions.scalars import lot_grid

    share = F.coalesce(F.try_divide(forecast * target, vol), F.lit(0.0))
    capped = F.greatest(F.least(share, F.lit(max_leverage)), F.lit(-max_leverage))
    return lot_grid(capped * equity / (price * costs.contract), costs.lot_step, costs.lot_step, costs.max_lot)


def no_new_risk(approved: Column, current: Column) -> Column:
    """approved, but not beyond the current exposure nor on its other side."""
    return F.when(current > 0, F.least(F.greatest(approved, F.lit(0.0)), current)).when(current < 0, F.greatest(F.least(approved, F.lit(0.0)), current)).otherwise(0.0)


def toward_zero(approved: Column, wanted: Column) -> Column:
    return F.when(wanted > 0, F.least(F.greatest(approved, F.lit(0.0)), wanted)).when(wanted < 0, F.greatest(F.least(approved, F.lit(0.0)), wanted)).otherwise(0.0)


SIM = "series_id long, time timestamp_ntz, position double, price double, pnl double, equity double, halted boolean, reason string, swap double, deals array<struct<lots:double,price:double,cost:double,reason:string>>"


def simulate(
    bars: DataFrame, forecast: str, costs: Costs, *, vol: str = "vol", equity: float = 100_000.0, target: float = 0.1, max_leverage: float = 3.0, band: float = 0.1, stop_mult: float | None = None, take_mult: float | None = None,
    cooldown: int = 0, max_drawdown: float = 0.3, night_long: float = 0.0, night_short: float = 0.0,
) -> DataFrame:
    """The stateful book of each series: sizing with a no-trade band, reduce-only risk, stops, targets, kill switch.

    A bar's forecast trades at the next open; the order within a bar is gap and its financing, fill, protective exit,
    mark. Stops and targets are fixed at entry, in volatilities. After a protective exit there is no new entry for
    `cooldown` bars. Ruin closes the position at the mark. night_long and night_short: annual rates that a long pays and a
    short is paid, a weighted night being 1 / 360 of them. deals: the fills of a bar in order, lots signed.
    """
    names = ["open", "high", "low", "close", "spread", forecast, vol]
    out_names = [c.split()[0] for c in SIM.split(", ")]

    def book(rows: list[list[float]]) -> list[tuple]:
        cash, peak, pos, stop, goal, halted, wanted, out, last, wait = equity, equity, 0.0, None, None, False, 0.0, [], None, 0
        for open_, high, low, close, spread, f, v, nights in zip(*rows, strict=True):
            reason, before, deals, swap = "", cash, [], 0.0
            if last is not None:
                cash += pos * costs.contract * (open_ - last)
                if pos and nights:
                    swap = -pos * costs.contract * last * (night_long if pos > 0 else night_short) * nights / 360
                    cash += swap
            half = max(spread * costs.spread_mult, costs.min_spread) / 2
            if wanted != pos:
                size = abs(wanted - pos)
                cost = size * costs.contract * (half + costs.slippage(high - low, size)) + size * costs.commission
                cash -= cost
                deals.append((wanted - pos, open_, cost, "fill"))
                if wanted and (pos == 0 or wanted * pos < 0):
                    unit = (v if v == v else 0.0) * open_
                    stop = open_ - math.copysign(stop_mult * unit, wanted) if stop_mult is not None and unit > 0 else None
                    goal = open_ + math.copysign(take_mult * unit, wanted) if take_mult is not None and unit > 0 else None
                pos, reason = wanted, "fill"
                if not pos:
                    stop = goal = None
            why, level = intrabar_exit(pos, open_, high, low, stop, goal) if stop is not None or goal is not None else (None, None)
            at = open_
            if why:
                cost = abs(pos) * costs.commission
                cash += pos * costs.contract * (level - at) - cost
                deals.append((-pos, level, cost, why))
                pos, stop, goal, reason, wait = 0.0, None, None, why, cooldown + 1
            cash += pos * costs.contract * (close - at)
            peak = max(peak, cash)
            if cash <= 0 or cash < peak * (1 - max_drawdown):
                halted = True
            if cash <= 0 and pos:
                cost = abs(pos) * costs.commission
                cash -= cost
                deals.append((-pos, close, cost, "ruin"))
                pos, stop, goal, reason = 0.0, None, None, "ruin"
            wait = max(0, wait - 1)
            share = 0.0 if f != f or v != v or v <= 0 else max(-max_leverage, min(max_leverage, f * target / v))
            lots = math.floor(abs(share) * max(cash, 0) / (close * costs.contract) / costs.lot_step + 1e-9) * costs.lot_step
            ask = math.copysign(min(lots, costs.max_lot), share) if lots else 0.0
            # a change small beside the larger side is left, but never to or from flat, over to the other side, or above the cap
            full = min(max_leverage * max(cash, 0) / (close * costs.contract), costs.max_lot)
            stays = band > 0 and ask * pos > 0 and abs(pos) <= full + 1e-12 and abs(ask - pos) < band * max(abs(ask), abs(pos))
            wanted = 0.0 if halted or (wait and not pos) else pos if stays else ask
            out.append((pos, cash - before, cash, halted, reason, swap, deals))
            last = close
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_series(batches, "series_id"):
            columns = [whole[c].to_numpy(float).tolist() for c in [*names, "__nights"]]
            done: list[tuple] = []
            for s, e in spans(whole["series_id"].to_numpy()):
                done += book([c[s:e] for c in columns])
            pos, pnl, cash, halted, reason, swap, deals = zip(*done, strict=True)
            yield pd.DataFrame({"series_id": whole["series_id"], "time": whole["time"], "position": pos, "price": whole["close"], "pnl": pnl, "equity": cash, "halted": halted, "reason": reason, "swap": swap, "deals": [[dict(zip(("lots", "price", "cost", "reason"), d, strict=True)) for d in x] for x in deals]})[out_names]

    held = rollover_nights(F.lag("time").over(series()), F.col("time")) if night_long or night_short else F.lit(0)
    needed = bars.select("series_id", "time", *dict.fromkeys(names), F.coalesce(held, F.lit(0)).cast("double").alias("__nights"))
    return by_series(needed, "series_id", "time").mapInPandas(run, SIM)


def sim_fills(sim: DataFrame) -> DataFrame:
    """(series_id, time, k, lots, price, cost, reason, position_after): the deals of simulated books."""
    w = series().orderBy("time", "k")
    rows = sim.filter(F.size("deals") > 0).select("series_id", "time", F.posexplode("deals").alias("k", "d")).select("series_id", "time", "k", "d.*")
    return rows.withColumn("position_after", F.round(F.sum("lots").over(w.rowsBetween(Window.unboundedPreceding, 0)), 8))


def sim_trades(fills: DataFrame, contract: float = 100.0) -> DataFrame:
    """(series_id, trade, side, entry_time, exit_time, lots, entry_price, exit_price, cost, pnl, exit_reason, open) of sim_fills().

    A reversal is split at 0, its cost by the lots of both parts. pnl, without financing, is what deals paid in and
    out; of an open trade it is null.
    """
    w = series().orderBy("time", "k")
    before = F.round(F.col("position_after") - F.col("lots"), 8)
    closing = F.when(before * F.col("lots") < 0, F.signum("lots") * F.least(F.abs("lots"), F.abs(before))).otherwise(0.0)
    part = lambda kind, lots: F.struct(F.lit(kind).alias("kind"), lots.alias("lots"))
    each = fills.withColumn("p", F.explode(F.filter(F.array(part(0, closing), part(1, F.col("lots") - closing)), lambda x: F.abs(x["lots"]) > 1e-9)))
    each = each.withColumns({"share": F.col("cost") * F.col("p.lots") / F.col("lots"), "begins": ((F.col("p.kind") == 1) & ((before == 0) | (before * F.col("lots") < 0))).cast("long"), "kind": F.col("p.kind"), "own": F.col("p.lots")})
    each = each.withColumn("trade", F.sum("begins").over(w.orderBy("time", "k", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    opened, shut = F.when(F.col("kind") == 1, F.col("own")), F.when(F.col("kind") == 0, -F.col("own"))
    last = F.struct("time", "k", "kind")
    done = each.groupBy("series_id", "trade").agg(
        F.signum(F.min_by("own", last)).alias("side"), F.min("time").alias("entry_time"), F.max(F.when(F.col("kind") == 0, F.col("time"))).alias("__out"), F.sum(F.abs(opened)).alias("lots"),
        F.try_divide(F.sum(opened * F.col("price")), F.sum(opened)).alias("entry_price"), F.try_divide(F.sum(shut * F.col("price")), F.sum(shut)).alias("exit_price"), F.sum("share").alias("cost"),
        (-contract * F.sum(F.col("own") * F.col("price"))).alias("__flow"), F.round(F.sum("own"), 8).alias("__left"), F.max_by("reason", last).alias("__why"),
    )
    open_ = F.col("__left") != 0
    return done.select("series_id", "trade", "side", "entry_time", F.when(~open_, F.col("__out")).alias("exit_time"), "lots", "entry_price", "exit_price", "cost", F.when(~open_, F.col("__flow") - F.col("cost")).alias("pnl"), F.when(~open_, F.col("__why")).alias("exit_reason"), open_.alias("open"))


def trade_stats(book: DataFrame) -> DataFrame:
    """Per series: bars, share in the market, return, Sharpe a bar, maximum drawdown."""
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    rows = book.withColumns({"r": F.col("pnl") / (F.col("equity") - F.col("pnl")), "dd": F.col("equity") / F.max("equity").over(w) - 1})
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("bars"), F.avg((F.col("position") != 0).cast("double")).alias("exposure"), F.sum("pnl").alias("pnl"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"), F.min("dd").alias("max_drawdown"))
