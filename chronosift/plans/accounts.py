"""Registered queries on sizing, financing, books, label weights and combination; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators import books, financing, labels, sizing
from chronosift.operators.execution import target_lots_pnl
from chronosift.plans.market import _CONC, BARS, MACRO, W, _barriers
from chronosift.plans.research import _TARGETS, COSTS, _targets
from chronosift.sources import tables as T

_Q: dict = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- sizing -----------------------------------------------------------------
_REQ = (
    "q AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 21 - 10) / 8.0::DOUBLE END AS forecast, CASE WHEN event_id % 19 = 0 THEN 0.0 ELSE 0.01 + (event_id % 40) / 100.0 END::DOUBLE AS vol, "
    "CASE WHEN event_id % 23 = 0 THEN -1.0 ELSE 50000 + value * 100 END::DOUBLE AS equity, (20 + event_id % 50)::DOUBLE AS price, (event_id % 9 - 4)::DOUBLE AS current, -(event_id % 25) / 100.0::DOUBLE AS drawdown, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 7) / 2.0::DOUBLE END AS atr FROM events)"
)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return T.table(spark, sf, "events").select(
        "event_id", F.when(e % 13 != 0, (e % 21 - 10) / 8.0).alias("forecast"), F.when(e % 19 == 0, 0.0).otherwise(0.01 + (e % 40) / 100.0).alias("vol"), F.when(e % 23 == 0, -1.0).otherwise(50_000 + F.col("value") * 100).alias("equity"),
        (20 + e % 50).cast("double").alias("price"), (e % 9 - 4).cast("double").alias("current"), (-(e % 25) / 100.0).alias("drawdown"), F.when(e % 3 != 0, (e % 7) / 2.0).alias("atr"),
    )


def _grid(x: str) -> str:
    return f"(CASE WHEN floor(abs({x}) / 0.01 + 1e-9) * 0.01 < 0.01 - 1e-12 THEN 0.0 ELSE sign({x}) * least(floor(abs({x}) / 0.01 + 1e-9) * 0.01, 50.0) END)::DOUBLE"


_MULT = "(CASE WHEN abs(drawdown) >= 0.15 - 1e-12 THEN 0.25 WHEN abs(drawdown) >= 0.1 - 1e-12 THEN 0.5 ELSE 1.0 END)::DOUBLE"
_BAND = "(rounded * current > 0 AND abs(current) <= cap + 1e-12 AND abs(rounded - current) < 0.1 * greatest(abs(rounded), abs(current)))"


@register(
    f"WITH {_REQ}, a AS (SELECT *, coalesce(forecast <> 0 AND vol > 0 AND equity > 0, false) AS live, greatest(vol, 0.03) AS v FROM q), "
    "b AS (SELECT *, CASE WHEN live THEN greatest(-1, least(1, forecast)) * 0.1::DOUBLE / v * equity ELSE 0.0 END::DOUBLE AS raw_notional, CASE WHEN live THEN least(1.5::DOUBLE * equity, 0.5::DOUBLE * equity / v) ELSE 0.0 END::DOUBLE AS lim FROM a), "
    f"c AS (SELECT *, greatest(least(raw_notional, lim), -lim) AS capped_notional, CASE WHEN live THEN {_MULT} ELSE 1.0 END::DOUBLE AS multiplier FROM b), "
    "d AS (SELECT *, CASE WHEN live THEN greatest(least(capped_notional * multiplier / (100 * price), 50), -50) ELSE 0.0 END::DOUBLE AS raw_lots, CASE WHEN live THEN least(50, lim * multiplier / (100 * price)) ELSE 0.0 END::DOUBLE AS cap FROM c), "
    f"e AS (SELECT *, {_grid('raw_lots')} AS rounded FROM d), f AS (SELECT *, live AND {_BAND} AS kept FROM e) "
    f"SELECT event_id, raw_notional, capped_notional, multiplier, raw_lots, rounded AS rounded_lots, kept, CASE WHEN kept THEN {_grid('current')} ELSE rounded END AS lots FROM f"
)
def sizing_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility-target sizing with leverage and Kelly caps, drawdown steps and a no-trade band."""
    rows = sizing.vol_target(_requests(spark, sf), sizing.VolTarget(max_leverage=1.5, kelly=0.5), COSTS)
    return rows.select("event_id", "raw_notional", "capped_notional", "multiplier", "raw_lots", "rounded_lots", "kept", "lots")


@register(
    f"WITH {_REQ}, a AS (SELECT *, 2.5::DOUBLE * CASE WHEN atr > 0 THEN atr WHEN vol > 0 THEN price * vol / sqrt(252.0::DOUBLE) END AS stop_distance FROM q), "
    f"b AS (SELECT *, coalesce(forecast <> 0 AND equity > 0 AND stop_distance > 0, false) AS live, least(50, 3.0::DOUBLE * equity / (100 * price)) AS cap, greatest(-1, least(1, forecast)) * 0.01::DOUBLE * equity * {_MULT} / (stop_distance * 100) AS s FROM a), "
    "c AS (SELECT *, CASE WHEN live THEN greatest(least(s, cap), -cap) ELSE 0.0 END::DOUBLE AS raw FROM b), "
    f"d AS (SELECT *, {_grid('raw')} AS rounded FROM c) "
    f"SELECT event_id, stop_distance, CASE WHEN live AND {_BAND} THEN {_grid('current')} ELSE rounded END AS lots, abs(current * 100 * price) * 0.05::DOUBLE AS margin, current * 100 * price AS notional, current * 100 * (price + 1 - price) AS pnl FROM d"
)
def sizing_fixed_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-fraction sizing by the stop's distance, with margin, notional and price pnl of the current lots."""
    rows = sizing.fixed_fraction(_requests(spark, sf), sizing.FixedFraction(band=0.1), COSTS)
    c, p = F.col("current"), F.col("price")
    return rows.select("event_id", "stop_distance", "lots", sizing.margin(c, p).alias("margin"), sizing.notional(c, p).alias("notional"), sizing.price_pnl(c, p, p + 1).alias("pnl"))


# ---- financing --------------------------------------------------------------
_SPANS = "s AS (SELECT event_id, ts AS start, ts + to_hours((event_id % 200)::BIGINT) AS stop, (event_id % 5 - 2)::DOUBLE AS lots, 20 + value AS price FROM events)"
_CURVE = f"{MACRO}, curve AS (SELECT available_at AS published, value / 1e9 * 0.01 AS rate FROM macro WHERE name = '1-URGENT')"
_DAYS = "d AS (SELECT x + INTERVAL 21 HOUR AS r, CASE isodow(x) WHEN 3 THEN 3.0 WHEN 6 THEN 0.0 WHEN 7 THEN 0.0 ELSE 1.0 END::DOUBLE AS n FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-03-01', INTERVAL 1 DAY) g(x))"
MODEL = financing.Financing()


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return T.table(spark, sf, "events").select("event_id", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(hours=e.cast("int") % 200)).alias("stop"), (e % 5 - 2).cast("double").alias("lots"), (20 + F.col("value")).alias("price"))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    return financing.rate_curve(T.macro(spark, sf).filter("name = '1-URGENT'").withColumn("value", F.col("value") / 1e9))


@register(
    f"WITH {_SPANS}, {_CURVE}, {_DAYS}, k AS (SELECT r, n, coalesce(rate, 0.03)::DOUBLE AS rate FROM d ASOF LEFT JOIN curve ON r >= published), "
    "j AS (SELECT event_id, coalesce(sum(n), 0)::DOUBLE AS nights, coalesce(sum(n * rate), 0)::DOUBLE AS rate_nights FROM s LEFT JOIN k ON r > start AND r <= stop GROUP BY 1) "
    "SELECT event_id, nights, rate_nights, CASE WHEN lots = 0 OR nights = 0 THEN 0.0 ELSE -lots * 100 * price * (rate_nights + CASE WHEN lots > 0 THEN 0.025 ELSE -0.025 END::DOUBLE * nights) / 360 END::DOUBLE AS swap FROM s JOIN j USING (event_id)"
)
def swap_by_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Financing of every event's span by the benchmark as of each rollover."""
    return financing.swap_between(_spans(spark, sf), ["event_id"], _curve(spark, sf), MODEL).select("event_id", "nights", "rate_nights", "swap")


@register(
    f"WITH {_SPANS}, {_DAYS}, j AS (SELECT event_id, coalesce(sum(n), 0)::DOUBLE AS nights FROM s LEFT JOIN d ON r > start AND r <= stop GROUP BY 1) SELECT event_id, CASE WHEN lots > 0 THEN lots * -40 * nights WHEN lots < 0 THEN -lots * 15 * nights ELSE 0 END::DOUBLE AS fixed_swap, "
    "CASE WHEN lots = 0 THEN 0 ELSE -lots * 100 * price * (0.04::DOUBLE + CASE WHEN lots > 0 THEN 0.025 ELSE -0.025 END::DOUBLE) / 360 END::DOUBLE AS one_night, 0.04::DOUBLE + CASE WHEN lots > 0 THEN 0.025 ELSE -0.025 END::DOUBLE AS annual_rate, "
    "2 * ((0.1::DOUBLE + 0.02::DOUBLE + 0.05::DOUBLE * 2) * abs(lots) * 100 + abs(lots) * 3.5::DOUBLE) AS round_trip, price + 0.1::DOUBLE + 0.02::DOUBLE + 0.05::DOUBLE * 2 AS bought_at, price - 0.1::DOUBLE AS sold_at FROM s JOIN j USING (event_id)"
)
def swap_fixed_and_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed swaps by closed-form nights, one night's financing, round trips and fill prices."""
    lots, price = F.col("lots"), F.col("price")
    fixed = financing.Financing(mode="fixed")
    k = F.lit(0.04)
    return _spans(spark, sf).select(
        "event_id", (financing.fixed_swap(lots, F.col("start"), F.col("stop"), fixed) + 0.0).alias("fixed_swap"), (financing.nightly(lots, price, k, MODEL) + 0.0).alias("one_night"), financing.annual_rate(lots, k, MODEL).alias("annual_rate"),
        financing.round_trip(lots, F.lit(0.2), F.lit(2.0), COSTS).alias("round_trip"), financing.fill_price(F.lit(1), price, F.lit(0.2), F.lit(2.0), lots * 0, COSTS).alias("bought_at"), financing.fill_price(F.lit(-1), price, F.lit(0.2), F.lit(2.0), lots, COSTS, limit=True).alias("sold_at"),
    )


# ---- books ------------------------------------------------------------------
BOOK = (
    f"{_TARGETS}, pa AS (SELECT *, coalesce(lag(target) {W}, 0) AS position, coalesce(lag(target, 2) {W}, 0) AS prior, coalesce(lag(close) {W}, open) AS pc FROM t), pb AS (SELECT *, abs(position - prior) AS traded FROM pa), "
    "pc AS (SELECT *, CASE WHEN traded > 0 THEN traded * 100 * (spread / 2 + 0.02::DOUBLE + 0.05::DOUBLE * (high - low)) + traded * 3.5::DOUBLE ELSE 0.0 END AS cost, 100 * (prior * (open - pc) + position * (close - open)) AS gross FROM pb), "
    f"book AS (SELECT series_id, time, open, close, position, cost, gross, gross - cost AS pnl, 10000000 + sum(gross - cost) {W} AS equity FROM pc)"
)
_DATE = "CASE isodow((time + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)::DATE) WHEN 6 THEN (time + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)::DATE + 2 WHEN 7 THEN (time + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)::DATE + 1 ELSE (time + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)::DATE END::DATE"
DAY = f"da AS (SELECT {_DATE} AS date, arg_max(equity, time) AS equity FROM book GROUP BY 1), day AS (SELECT date, equity, equity / coalesce(lag(equity) OVER (ORDER BY date), (SELECT arg_min(equity, time) FROM book)) - 1 AS ret FROM da)"


def _book(spark: SparkSession, sf: str) -> DataFrame:
    return target_lots_pnl(_targets(spark, sf), "lots", COSTS, equity=10_000_000.0)


@register(f"WITH {BOOK}, {DAY} SELECT date, equity, ret FROM day")
def book_daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Last equity a trading day (by the bar's close, weekends to Monday) and its return."""
    return books.daily_returns(_book(spark, sf), "1 hour").select("date", "equity", "ret")


@register(
    f"WITH {BOOK}, a AS (SELECT *, coalesce(lag(position) {W}, 0) AS b FROM book) SELECT time, sign(position - b)::DOUBLE AS side, abs(position - b) AS lots, open AS price, CASE WHEN b * (position - b) < 0 THEN least(abs(b), abs(position - b)) ELSE 0.0 END::DOUBLE AS closing, cost, position AS position_after FROM a WHERE position <> b"
)
def book_fills(spark: SparkSession, sf: str) -> DataFrame:
    return books.fills(_book(spark, sf)).select("time", "side", "lots", "price", "closing", "cost", "position_after")


TRADES = (
    f"ta AS (SELECT *, coalesce(lag(position) {W}, 0) AS b, coalesce(lag(close) {W}, open) AS pc FROM book), tb AS (SELECT *, CASE WHEN position <> 0 AND sign(b) <> sign(position) THEN 1 ELSE 0 END AS nw FROM ta), "
    f"tc AS (SELECT *, sum(nw) {W} AS trade, abs(position - b) AS traded, CASE WHEN b * (position - b) < 0 THEN least(abs(b), abs(position - b)) ELSE 0.0 END::DOUBLE AS closing FROM tb), "
    "td AS (SELECT *, CASE WHEN traded > 0 THEN closing / traded * cost ELSE 0.0 END AS share FROM tc), "
    "te AS (SELECT trade - nw AS trade, 100 * b * (open - pc) AS gross, share AS cost, 0 AS held, CASE WHEN position * b <= 0 THEN time END AS gone, 0.0::DOUBLE AS opened, 0.0::DOUBLE AS paid, 0.0::DOUBLE AS size, NULL::TIMESTAMP AS begun, sign(b) AS side FROM td WHERE b <> 0 "
    "UNION ALL SELECT trade, 100 * position * (close - open), cost - share, 1, NULL, traded - closing, (traded - closing) * open, abs(position), time, sign(position) FROM td WHERE position <> 0), "
    "trades AS (SELECT trade::BIGINT AS trade, max(side)::DOUBLE AS side, min(begun) AS entry_time, max(gone) AS exit_time, sum(held)::BIGINT AS bars_held, max(size) AS lots, sum(paid) / sum(opened) AS entry_price, sum(gross) AS gross, sum(cost) AS cost, sum(gross) - sum(cost) AS pnl, max(gone) IS NULL AS open FROM te GROUP BY 1)"
)


@register(f"WITH {BOOK}, {TRADES} SELECT * FROM trades")
def book_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Round trips of the book, a reversal sharing its cost between both."""
    return books.trades(_book(spark, sf)).drop("series_id")


@register(
    f"WITH {BOOK}, {TRADES}, k AS (SELECT 'all' AS kind, * FROM trades UNION ALL SELECT CASE WHEN side > 0 THEN 'long' ELSE 'short' END, * FROM trades) "
    "SELECT kind, count(*) AS n, count(*) FILTER (WHERE pnl > 0) / count(*)::DOUBLE AS win_rate, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, -avg(pnl) FILTER (WHERE pnl > 0) / avg(pnl) FILTER (WHERE pnl < 0) AS payoff, "
    "-sum(pnl) FILTER (WHERE pnl > 0) / sum(pnl) FILTER (WHERE pnl < 0) AS profit_factor, avg(pnl) AS expectancy, max(pnl) AS largest_win, min(pnl) AS largest_loss, avg(bars_held)::DOUBLE AS avg_bars, sum(cost) AS cost FROM k GROUP BY 1"
)
def book_trade_table(spark: SparkSession, sf: str) -> DataFrame:
    return books.trade_table(books.trades(_book(spark, sf))).drop("series_id")


_UNDER = (
    f"ma AS (SELECT *, max(equity) {W} AS top, equity / lag(equity) {W} - 1 AS r, abs(position - coalesce(lag(position) {W}, 0)) AS turn FROM book), mb AS (SELECT *, equity < top AS under FROM ma), "
    f"mc AS (SELECT *, max(CASE WHEN NOT under THEN time END) {W} AS peak, coalesce(lag(under) {W}, false) AS was FROM mb), md AS (SELECT *, CASE WHEN under THEN epoch_us(time) - epoch_us(peak) WHEN was THEN epoch_us(time) - epoch_us(lag(peak) {W}) END AS uw FROM mc)"
)
_M = "(s1 / n)"
_C2 = f"(s2 / n - {_M} * {_M})"
_C3 = f"(s3 / n - 3 * {_M} * s2 / n + 2 * {_M} * {_M} * {_M})"
_C4 = f"(s4 / n - 4 * {_M} * s3 / n + 6 * {_M} * {_M} * s2 / n - 3 * {_M} * {_M} * {_M} * {_M})"


@register(
    f"WITH {BOOK}, {DAY}, {TRADES}, {_UNDER}, "
    "b AS (SELECT count(*) AS n_bars, arg_min(equity, time) AS first, arg_max(equity, time) AS final_equity, (epoch_us(max(time)) - epoch_us(min(time))) / 1e6 / (365.25 * 86400) AS years, avg(r) / stddev_samp(r) * sqrt(6048.0::DOUBLE) AS sharpe_bar, min(equity / top - 1) AS max_drawdown, coalesce(max(uw), 0) / 86400e6 AS max_dd_duration_days, avg((abs(position) > 1e-12)::INTEGER)::DOUBLE AS exposure, sum(turn) AS traded, sum(cost) AS total_costs, avg(equity) AS me FROM md), "
    "d AS (SELECT count(ret) AS n_days, count(ret)::DOUBLE AS n, sum(ret) AS s1, sum(ret * ret) AS s2, sum(ret ** 3) AS s3, sum(ret ** 4) AS s4, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.95) AS q95, max(ret) AS best_day, min(ret) AS worst_day, sqrt(sum(least(ret, 0) ** 2) / count(ret)) AS down FROM day), "
    "c AS (SELECT -avg(ret) AS cvar_95_daily FROM day, d WHERE ret <= q05), "
    "x AS (SELECT count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) / count(*)::DOUBLE AS win_rate, -sum(pnl) FILTER (WHERE pnl > 0) / sum(pnl) FILTER (WHERE pnl < 0) AS profit_factor, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, avg(pnl) AS expectancy, avg(bars_held)::DOUBLE AS avg_hold_bars FROM trades WHERE NOT open), "
    f"v AS (SELECT *, final_equity / first - 1 AS total_return, (final_equity / first) ** (1 / years) - 1 AS cagr, sqrt({_C2} * n / (n - 1)) AS sd FROM b, d, c, x) "
    f"SELECT total_return, cagr, sd * sqrt(252.0::DOUBLE) AS ann_vol, {_M} / sd * sqrt(252.0::DOUBLE) AS sharpe, sharpe_bar, {_M} / down * sqrt(252.0::DOUBLE) AS sortino, max_drawdown, cagr / abs(max_drawdown) AS calmar, max_dd_duration_days, "
    f"sqrt(n * (n - 1)) / (n - 2) * {_C3} / {_C2} ** 1.5 AS skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * {_C4} / ({_C2} * {_C2}) - 3 * (n - 1)) AS kurtosis, -q05 AS var_95_daily, cvar_95_daily, abs(q95) / abs(q05) AS tail_ratio, best_day, worst_day, n_trades, n_trades / years AS trades_per_year, win_rate, profit_factor, avg_win, avg_loss, expectancy, avg_hold_bars, "
    "exposure, traded / years AS turnover_lots_per_year, total_costs, total_costs / me / years AS cost_drag_ann, n_bars, n_days, years, 6048.0::DOUBLE AS bars_per_year, final_equity FROM v"
)
def book_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All figures of the hourly book."""
    return books.metrics(_book(spark, sf), width="1 hour", bars_per_year=6048.0).drop("series_id")


@register(f"WITH {BOOK} SELECT sum(cost) AS cost, sum(gross) AS gross, sum(gross) - sum(cost) AS net, sum(cost) / abs(sum(gross)) AS share_of_gross FROM book")
def book_cost_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return books.cost_attribution(_book(spark, sf)).drop("series_id")


_SHARES = "sh AS (SELECT time, strategy, CASE strategy WHEN 'a' THEN sin(epoch_us(time) / 3.6e9) WHEN 'b' THEN cos(epoch_us(time) / 7.2e9) ELSE CASE WHEN hour(time) = 3 THEN -(sin(epoch_us(time) / 3.6e9) + cos(epoch_us(time) / 7.2e9)) ELSE 0.3 END END::DOUBLE AS contribution FROM book, (VALUES ('a'), ('b'), ('c')) s(strategy))"


@register(
    f"WITH {BOOK}, {_SHARES}, o AS (SELECT time AS t, pnl, lag(time) {W} AS time FROM book), k AS (SELECT *, contribution / nullif(sum(contribution) OVER (PARTITION BY time), 0) AS share FROM sh WHERE hour(time) <> 3), "
    "z AS (SELECT t, coalesce(strategy, 'unattributed') AS strategy, pnl * coalesce(share, 1) AS pnl FROM o LEFT JOIN (SELECT * FROM k WHERE share IS NOT NULL) k USING (time)) SELECT year(t)::INTEGER AS year, strategy, sum(pnl) AS pnl FROM z GROUP BY ALL"
)
def book_pnl_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Each bar's pnl by the shares of the contributions a bar before; none at 3 o'clock, where it stays unattributed."""
    book = _book(spark, sf)
    us = F.unix_micros(F.col("time").cast("timestamp"))
    c = book.filter(F.hour("time") != 3).select("series_id", "time", F.explode(F.create_map(F.lit("a"), F.sin(us / 3.6e9), F.lit("b"), F.cos(us / 7.2e9), F.lit("c"), F.lit(0.3))).alias("strategy", "contribution"))
    return books.pnl_attribution(book, c, by_year=True).select("year", "strategy", "pnl")


@register(f"WITH {BOOK}, h AS (SELECT *, equity < 10000000 - 2000 AS halted FROM book), k AS (SELECT halted, CASE WHEN halted AND NOT coalesce(lag(halted) {W}, false) THEN 1 ELSE 0 END AS b FROM h) SELECT sum(b)::BIGINT AS episodes, sum(halted::INTEGER)::BIGINT AS bars FROM k")
def book_halt_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return books.halt_episodes(_book(spark, sf).withColumn("halted", F.col("equity") < 10_000_000 - 2000)).drop("series_id")


@register(f"WITH {BOOK}, {DAY}, w AS (SELECT * FROM day WHERE date >= DATE '2024-01-08' AND date < DATE '2024-01-22') SELECT count(ret) AS days, exp(sum(ln(1 + ret))) - 1 AS ret, avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) AS sharpe FROM w")
def book_window_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return books.window_sharpe(_book(spark, sf), "2024-01-08", "2024-01-22", "1 hour").drop("series_id")


@register(
    "WITH e AS (SELECT ts AS time, unnest(CASE WHEN event_id % 2 = 0 THEN ['spread 1.2 > 1', ' halted: ' || event_type] ELSE [event_type || ' limit'] END) AS r FROM events) SELECT regexp_extract(trim(r), '^([A-Za-z_]+)', 1) AS rule, count(*) AS n, min(time) AS first, max(time) AS last FROM e GROUP BY 1"
)
def risk_event_table(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    reasons = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("spread 1.2 > 1; halted: "), "event_type")).otherwise(F.concat("event_type", F.lit(" limit")))
    return books.risk_event_table(e.select(F.col("ts").alias("time"), reasons.alias("reasons")))


@register()
def simulated_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Round trips of a stateful book a user, with stops, targets, cooldown and financing; tests hold them against equity."""
    from chronosift.functions import ewm
    from chronosift.operators import execution
    from chronosift.plans import rules

    rows = ewm.with_kernels(rules.zscore_fade(T.bars(spark, sf, "1 day", by_series=True), 5, 1.0), {"vol": lambda p: ewm.ewma_vol(p, 10, 3) * 252**0.5})
    sim = execution.simulate(rows, "zscore_fade", COSTS, stop_mult=0.5, take_mult=1.0, cooldown=2, night_long=0.05, night_short=-0.02)
    return execution.sim_trades(execution.sim_fills(sim))


# ---- label weights ----------------------------------------------------------
_UNIQ = f"{_CONC}, cl AS (SELECT row_number() OVER (ORDER BY time) - 1 AS pos, ln(close / lag(close) OVER (ORDER BY time)) AS r FROM bars)"


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("time")
    return T.bars(spark, sf).select("series_id", (F.row_number().over(w) - 1).alias("pos"), F.ln(F.col("close") / F.lag("close").over(w)).alias("r"))


@register(
    f"WITH {_UNIQ}, kx AS (SELECT a.pos, CASE WHEN active > 0 THEN coalesce(r, 0) / active ELSE 0 END AS x FROM a JOIN cl ON a.pos = cl.pos), jx AS (SELECT t_idx, t1_idx, abs(coalesce((SELECT sum(x) FROM kx WHERE kx.pos > y.t_idx AND kx.pos <= y.t1_idx), 0)) AS w FROM y WHERE t1_idx IS NOT NULL) SELECT t_idx, t1_idx, w / avg(w) OVER () AS weight FROM jx"
)
def label_return_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The size of each label's own share of returns, of mean 1."""
    b, p = _barriers(spark, sf), _positions(spark, sf)
    return labels.return_weights(b, labels.concurrency(b, p.select("series_id", "pos")), p).select("t_idx", "t1_idx", "weight")


@register(
    f"WITH {_CONC}, u AS (SELECT t_idx, t1_idx, coalesce((SELECT avg(1.0::DOUBLE / active) FROM a WHERE a.pos > y.t_idx AND a.pos <= y.t1_idx), 1.0::DOUBLE) AS u FROM y WHERE t1_idx IS NOT NULL), "
    "c AS (SELECT *, sum(u) OVER (ORDER BY t_idx) AS x, sum(u) OVER () AS total FROM u) SELECT t_idx, u / avg(u) OVER () AS weight, greatest(0, 1 - 0.7::DOUBLE + 0.7::DOUBLE / total * x) AS decay, greatest(0, 1 - 1 / 0.5::DOUBLE + 1 / (0.5::DOUBLE * total) * x) AS cut FROM c"
)
def label_decay_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Uniqueness of mean 1, and decay to 0.3 and to 0 for the oldest half."""
    b = _barriers(spark, sf)
    u = labels.uniqueness(b, labels.concurrency(b, _positions(spark, sf).select("series_id", "pos")))
    rows = labels.decay_weights(labels.decay_weights(labels.mean_one(u, "uniqueness", "weight"), 0.3, out="decay"), -0.5, out="cut")
    return rows.select("t_idx", "weight", "decay", "cut")


@register(f"WITH {_CONC}, mx AS (SELECT t_idx, max(t1_idx) AS e FROM y GROUP BY 1), zz AS (SELECT max(pos) AS last FROM n) SELECT pos::BIGINT AS pos, greatest(pos, coalesce(e, pos))::BIGINT AS label_end, pos <= last - 20 AS stays FROM n LEFT JOIN mx ON mx.t_idx = n.pos, zz")
def label_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The last bar that a label starting at each bar reaches, and whether a label there may stay at the data's end."""
    b, p = _barriers(spark, sf), _positions(spark, sf).select("series_id", "pos")
    return labels.with_tail(labels.label_ends(b, p), 20).select(F.col("pos").cast("long").alias("pos"), F.col("label_end").cast("long").alias("label_end"), "stays")
