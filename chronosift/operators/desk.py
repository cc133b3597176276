"""Risk decisions, order plans and journals as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .execution import Costs, no_new_risk, toward_zero


def approve(orders: DataFrame, *, costs: Costs, max_leverage: float = 3.0, max_spread: float = 1.0, max_age: float = 7200.0, max_trades: int = 20) -> DataFrame:
    """Adds approved and reason to (wanted, current, equity, price, spread, age, trades_today, blackout, halted).

    In order: a halt flattens; exposure is capped; in a blackout, with a wide spread, stale data or too many
    trades nothing may add risk; invalid inputs change nothing. Approval never exceeds what was wanted.
    """
    cap = max_leverage * F.col("equity") / (F.col("price") * costs.contract)
    capped = F.greatest(F.least("wanted", F.least(cap, F.lit(costs.max_lot))), -F.least(cap, F.lit(costs.max_lot)))
    valid = (F.col("equity") > 0) & (F.col("price") > 0) & F.col("wanted").isNotNull() & ~F.isnan("wanted")
    reason = (
        F.when(F.coalesce("halted", F.lit(False)), "halted")
        .when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.coalesce("blackout", F.lit(False)), "blackout")
        .when(F.col("spread") > max_spread, "spread")
        .when(F.col("age") > max_age, "stale")
        .when(F.col("trades_today") >= max_trades, "trades")
        .when(capped != F.col("wanted"), "exposure")
        .otherwise("ok")
    )
    out = orders.withColumns({"__capped": capped, "reason": reason})
    approved = (
        F.when(F.col("reason") == "halted", 0.0)
        .when(F.col("reason") == "invalid", F.col("current"))
        .when(F.col("reason").isin("blackout", "spread", "stale", "trades"), no_new_risk(F.col("__capped"), F.col("current")))
        .otherwise(toward_zero(F.col("__capped"), F.col("wanted")))
    )
    return out.withColumn("approved", approved).drop("__capped")


def bounded_decision(quant: Column, action: Column, scale: Column, confidence: Column, *, least: float = 0.5, mode: str = "overlay") -> Column:
    """A desk's action bounded by the quantitative forecast: follow, veto, scale or override; else follow."""
    sure = F.coalesce(confidence >= least, F.lit(False))
    asked = F.when(~sure, quant).when(action == "veto", 0.0).when(action == "scale", quant * F.coalesce(scale, F.lit(1.0))).when(action == "override", F.coalesce(scale, quant)).otherwise(quant)
    if mode == "advisory":
        return quant
    if mode == "discretionary":
        return F.greatest(F.least(asked, F.lit(1.0)), F.lit(-1.0))
    return F.greatest(F.least(asked, F.greatest(quant, F.lit(0.0))), F.least(quant, F.lit(0.0)))


def order_legs(target: float, tickets: list[tuple[int, float]], *, step: float = 0.01, largest: float = 5.0) -> list[dict]:
    """Legs from open tickets (id, signed lots, oldest first) to a target: closings first, in chunks."""
    held = sum(x for _, x in tickets)
    if abs(target - held) < step / 2:
        return []
    legs, left = [], list(tickets)
    shut = held if target * held < 0 or target == 0 else max(0.0, abs(held) - abs(target)) * (1 if held > 0 else -1)
    for k, x in left:
        if x * held < 0:
            legs.append({"kind": "close", "ticket": k, "lots": abs(x)})
            continue
        take = min(abs(x), abs(shut))
        if take > step / 2:
            legs.append({"kind": "close", "ticket": k, "lots": round(take, 8)})
            shut -= take * (1 if shut > 0 else -1)
    now = held - sum(leg["lots"] * (1 if dict(tickets)[leg["ticket"]] > 0 else -1) for leg in legs)
    grow = target - now
    while abs(grow) > step / 2:
        size = min(abs(grow), largest)
        legs.append({"kind": "open", "ticket": None, "lots": round(size if grow > 0 else -size, 8)})
        grow -= size if grow > 0 else -size
    return legs


def journal_summary(events: DataFrame) -> DataFrame:
    """One row a cycle of (cycle_id, seq, event, status, tokens): last decision and policy, counts by event."""
    last = lambda kind: F.max_by(F.when(F.col("event") == kind, F.col("status")), F.when(F.col("event") == kind, F.col("seq")))
    return events.groupBy("cycle_id").agg(last("decision").alias("decision"), last("policy").alias("policy"), F.count_if(F.col("event") == "tool_call").alias("tool_calls"), F.count_if((F.col("event") == "tool_call") & (F.col("status") == "error")).alias("tool_errors"), F.sum("tokens").alias("tokens"))


def live_decisions(records: DataFrame, strategies: list[str]) -> DataFrame:
    """Flattens (time, combined, attribution map<string, struct<forecast, weight, contribution>>) to columns."""
    parts = [F.col("attribution")[s]["contribution"].alias(f"c_{s}") for s in strategies]
    return records.select("time", "combined", *parts)


def slippage_summary(fills: DataFrame, last: int = 50) -> DataFrame:
    """Per series: implementation shortfall of the newest fills, in price and in half spreads."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy(F.desc("time"))
    rows = fills.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= last)
    short = (F.col("price") - F.col("mid")) * F.signum("lots")
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("fills"), F.avg(short).alias("shortfall"), F.avg(F.try_divide(short, F.col("spread") / 2)).alias("half_spreads"))
