"""Registered queries on bars: resampling, joins, frames, runs, labels; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.functions.scalars import safe_div
from chronosift.operators import drawdown as dd
from chronosift.operators import islands, labels, rolling
from chronosift.operators.asof import asof_join
from chronosift.operators.intervals import blackout_spans, counts_within, within
from chronosift.operators.resample import resample_bars
from chronosift.operators.rolling import series
from chronosift.sources import tables as T

TICKS = "ticks AS (SELECT user_id AS series_id, ts AS time, value + 1 AS price, event_id AS seq, 0.1 + 0.001 * (event_id % 50)::DOUBLE AS spread FROM events)"
_AGG = "arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close, count(*)::DOUBLE AS volume, avg(spread) AS spread"
BARS = f"{TICKS}, bars AS (SELECT 0::BIGINT AS series_id, date_trunc('hour', time) AS time, {_AGG}, date_trunc('hour', time) + INTERVAL 1 HOUR AS available_at FROM ticks GROUP BY ALL)"
SERIES_BARS = f"{TICKS}, bars AS (SELECT series_id, time_bucket(INTERVAL 1 DAY, time) AS time, {_AGG}, time_bucket(INTERVAL 1 DAY, time) + INTERVAL 1 DAY AS available_at FROM ticks GROUP BY ALL)"
MACRO = "macro AS (SELECT o_orderpriority AS name, o_orderdate::DATE + 9131 AS date, sum(o_totalprice) AS value, (o_orderdate::DATE + 9131)::TIMESTAMP + INTERVAL 21 HOUR + INTERVAL 30 MINUTE AS available_at FROM orders GROUP BY ALL)"
CALENDAR = "calendar AS (SELECT ts AS time, event_type AS name, 1 + event_id % 3 AS importance, event_id AS seq FROM events WHERE event_type = 'error')"
DAILY = "daily AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS equity FROM orders GROUP BY 1)"
RETURNS = f"{DAILY}, returns AS (SELECT date, equity, equity / lag(equity) OVER (ORDER BY date) - 1 AS ret FROM daily)"
W = "OVER (PARTITION BY series_id ORDER BY time)"


def w(n: int, of: str = "series_id", order: str = "time") -> str:
    return f"OVER (PARTITION BY {of} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def g(expr: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {w(n)} = {n} THEN {expr} END"


_Q: dict = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


BAR_COLS = "series_id, time, open, high, low, close, volume, spread, available_at"


@register(f"WITH {BARS} SELECT {BAR_COLS} FROM bars")
def bars_resample_h1(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf)


@register(f"WITH {SERIES_BARS} SELECT {BAR_COLS} FROM bars")
def bars_daily_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf, "1 day", by_series=True)


_H4 = (
    "h4 AS (SELECT series_id, time_bucket(INTERVAL 4 HOUR, time, TIMESTAMP '2000-01-01 02:00:00') AS b, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, "
    "sum(volume) AS volume, avg(spread) AS spread, greatest(max(available_at), time_bucket(INTERVAL 4 HOUR, time, TIMESTAMP '2000-01-01 02:00:00') + INTERVAL 4 HOUR) AS available_at, max(available_at) AS la, min(time) AS ft FROM bars GROUP BY series_id, b)"
)
_H4_COMPLETE = "SELECT series_id, b AS time, open, high, low, close, volume, spread, available_at FROM h4 WHERE (b > (SELECT min(b) FROM h4) OR ft = b) AND (b < (SELECT max(b) FROM h4) OR la >= b + INTERVAL 4 HOUR)"


@register(f"WITH {BARS}, {_H4} {_H4_COMPLETE}")
def bars_resample_h4_anchor2(spark: SparkSession, sf: str) -> DataFrame:
    return resample_bars(T.bars(spark, sf), "4 hours", shift="2 hours")


@register(
    f"WITH {BARS} SELECT count(*) AS n_bars, count(*) FILTER (WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)) AS bad_price, count(*) FILTER (WHERE high < greatest(open, close, low) * (1 - 1e-9)) AS bad_high, "
    "count(*) FILTER (WHERE low > least(open, close, high) * (1 + 1e-9)) AS bad_low, count(*) FILTER (WHERE NOT volume >= 0) AS bad_volume, count(*) FILTER (WHERE NOT spread >= 0) AS bad_spread, "
    "count(*) FILTER (WHERE available_at <= time) AS bad_available FROM bars"
)
def bars_validate(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.sources.bars import rule_counts

    return rule_counts(T.bars(spark, sf))


@register("WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id AS series_id, date_trunc('hour', ts) AS time, value + 1 AS price, event_id AS seq FROM k WHERE r = 1")
def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.ticks(spark, sf).withColumn("hour", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    last = rows.groupBy("series_id", "hour").agg(F.max_by(F.struct("price", "seq"), F.struct("time", "seq")).alias("r"))
    return last.select("series_id", F.col("hour").alias("time"), "r.price", "r.seq")


@register(
    f"WITH {BARS}, {MACRO}, m AS (SELECT * FROM macro WHERE name = '1-URGENT'), f AS (SELECT series_id, time, close, available_at, ln(close / lag(close) {W}) AS r FROM bars), "
    f"z AS (SELECT *, CASE WHEN count(close) {w(20)} = 20 THEN (close - avg(close) {w(20)}) / nullif(stddev_samp(close) {w(20)}, 0) END AS z20 FROM f) "
    "SELECT z.series_id, z.time, z.close, z.r, z.z20, m.date AS macro_date, m.value AS macro_value FROM z ASOF LEFT JOIN m ON z.available_at >= m.available_at WHERE z20 IS NOT NULL"
)
def asof_macro_join(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: H1 bars, their return and z-score, and the macro value published by then."""
    base = T.bars(spark, sf).select("series_id", "time", "close", "available_at").withColumns({"r": rolling.log_return(F.col("close")), "z20": rolling.zscore(F.col("close"), 20)})
    one = T.macro(spark, sf).filter("name = '1-URGENT'").select(F.col("available_at").alias("published"), F.col("date").alias("macro_date"), F.col("value").alias("macro_value"))
    out = asof_join(base, one, left_time="available_at", right_time="published", columns=["macro_date", "macro_value"], slices="1 day")
    return out.filter("z20 IS NOT NULL").drop("available_at")


_ASOF_USER = (
    "e AS (SELECT user_id, date_trunc('hour', ts) AS slot, event_id AS eid, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events WHERE event_type = 'error'), "
    "d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, slot ORDER BY eid DESC) = 1)"
)


@register(f"WITH {_ASOF_USER} SELECT t.event_id, t.user_id, CASE WHEN t.ts - d.slot <= INTERVAL 2 DAY THEN d.eid END AS eid, CASE WHEN t.ts - d.slot <= INTERVAL 2 DAY THEN d.v END AS v FROM events t ASOF LEFT JOIN d ON t.user_id = d.user_id AND t.ts >= d.slot")
def asof_tolerance_dup_last(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.table(spark, sf, "events")
    right = ev.filter("event_type = 'error'").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("eid"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return asof_join(ev.select("event_id", "user_id", "ts"), right, on=["user_id"], left_time="ts", right_time="at", columns=["eid", "v"], seq="eid", tolerance="2 days").drop("ts")


@register(
    f"WITH {BARS}, {CALENDAR}, c AS (SELECT time, max(importance) AS importance FROM calendar GROUP BY 1) SELECT b.time, (epoch_us(n.time) - epoch_us(b.time)) / 3600000000.0::DOUBLE AS hours_to_next, (epoch_us(b.time) - epoch_us(l.time)) / 3600000000.0::DOUBLE AS hours_since_last "
    "FROM bars b ASOF LEFT JOIN c n ON b.time <= n.time ASOF LEFT JOIN c l ON b.time > l.time"
)
def next_last_event(spark: SparkSession, sf: str) -> DataFrame:
    base = T.bars(spark, sf).select("time")
    events = T.calendar(spark, sf).groupBy("time").agg(F.max("importance").alias("importance"))
    nxt = events.select(F.col("time").alias("next_time"))
    out = asof_join(base, nxt, right_time="next_time", columns=["next_time"], forward=True)
    out = asof_join(out, events.select(F.col("time").alias("last_time")), right_time="last_time", columns=["last_time"], strict=True)
    hours = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3_600_000_000.0
    return out.select("time", hours(F.col("time"), F.col("next_time")).alias("hours_to_next"), hours(F.col("last_time"), F.col("time")).alias("hours_since_last"))


@register(f"WITH {BARS}, {CALENDAR} SELECT b.time, (SELECT count(*) FROM calendar c WHERE c.time >= b.time AND c.time < b.time + INTERVAL 24 HOUR) AS n_events FROM bars b")
def events_in_24h(spark: SparkSession, sf: str) -> DataFrame:
    """Counts as differences of running counts over bars and events."""
    return counts_within(T.bars(spark, sf).select("time"), T.calendar(spark, sf), {"n_events": (0, 24 * 3600 * 1_000_000)})


_BLACK = f"{BARS}, {CALENDAR}"


@register(f"WITH {_BLACK} SELECT time, close FROM bars b WHERE EXISTS (SELECT 1 FROM calendar c WHERE c.importance >= 3 AND b.time BETWEEN c.time - INTERVAL 30 MINUTE AND c.time + INTERVAL 15 MINUTE)")
def blackout_semi(spark: SparkSession, sf: str) -> DataFrame:
    spans = blackout_spans(T.calendar(spark, sf), before="30 minutes", after="15 minutes", min_importance=3)
    return within(T.bars(spark, sf).select("time", "close"), spans, how="left_semi")


@register(f"WITH {_BLACK} SELECT time, close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM calendar c WHERE c.importance >= 3 AND b.time BETWEEN c.time - INTERVAL 30 MINUTE AND c.time + INTERVAL 15 MINUTE)")
def outside_blackout_anti(spark: SparkSession, sf: str) -> DataFrame:
    spans = blackout_spans(T.calendar(spark, sf), before="30 minutes", after="15 minutes", min_importance=3)
    return within(T.bars(spark, sf).select("time", "close"), spans, how="left_anti")


@register(f"WITH {BARS}, {_H4}, c AS ({_H4_COMPLETE}) SELECT b.time, b.close, c.close AS htf_close, c.high AS htf_high FROM bars b ASOF LEFT JOIN c ON b.available_at >= c.available_at")
def mtf_align(spark: SparkSession, sf: str) -> DataFrame:
    base = T.bars(spark, sf)
    htf = resample_bars(base, "4 hours", shift="2 hours").select(F.col("available_at").alias("htf_at"), F.col("close").alias("htf_close"), F.col("high").alias("htf_high"))
    return asof_join(base.select("time", "close", "available_at"), htf, left_time="available_at", right_time="htf_at", columns=["htf_close", "htf_high"]).drop("available_at")


_LR = f"{BARS}, f AS (SELECT *, ln(close / lag(close) {W}) AS r, row_number() {W}::DOUBLE AS pos, ln(open / lag(close) {W}) AS gap, close - lag(close) {W} AS d FROM bars)"
BPY = 6048.0


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf).withColumns({"r": rolling.log_return(F.col("close")), "pos": F.row_number().over(series()).cast("double"), "gap": F.ln(F.col("open") / F.lag("close").over(series())), "d": F.col("close") - F.lag("close").over(series())})


@register(f"WITH {_LR} SELECT time, r, {g(f'(close - avg(close) {w(20)}) / nullif(stddev_samp(close) {w(20)}, 0)', 'close', 20)} AS z20, {g(f'(close - avg(close) {w(50)}) / nullif(stddev_samp(close) {w(50)}, 0)', 'close', 50)} AS z50 FROM f")
def rolling_zscores(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, sf).select("time", "r", rolling.zscore(F.col("close"), 20).alias("z20"), rolling.zscore(F.col("close"), 50).alias("z50"))


_SD = f"stddev_pop(close) {w(20)}"
_MU = f"avg(close) {w(20)}"


@register(f"WITH {BARS} SELECT time, CASE WHEN count(*) {w(20)} = 20 THEN CASE WHEN {_SD} = 0 THEN 0 ELSE (close - {_MU}) / (2 * {_SD}) END END AS pct_b, CASE WHEN count(*) {w(20)} = 20 THEN CASE WHEN {_SD} = 0 THEN 0 ELSE 4 * {_SD} / {_MU} END END AS width FROM bars")
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    b, width = rolling.bollinger(20, 2.0, F.col("close"))
    return T.bars(spark, sf).select("time", b.alias("pct_b"), width.alias("width"))


_TOP, _LOW = g(f"max(high) {w(20)}", "high", 20), g(f"min(low) {w(20)}", "low", 20)


@register(f"WITH {BARS} SELECT time, {_TOP} AS upper, {_LOW} AS lower, CASE WHEN count(*) {w(20)} = 20 THEN coalesce(100 * (close - ({_LOW})) / nullif(({_TOP}) - ({_LOW}), 0), 50) END AS stoch_k FROM bars")
def donchian_stochastic(spark: SparkSession, sf: str) -> DataFrame:
    top, low = rolling.donchian(20)
    return T.bars(spark, sf).select("time", top.alias("upper"), low.alias("lower"), rolling.stochastic(20).alias("stoch_k"))


@register(f"WITH {BARS}, f AS (SELECT *, lag(close) {W} AS pc FROM bars) SELECT time, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM f")
def true_range(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf).select("time", rolling.true_range().alias("tr"))


@register(f"WITH {_LR} SELECT time, {g(f'regr_slope(close, pos) {w(20)}', 'close', 20)} AS slope, {g(f'CASE WHEN var_pop(close) {w(20)} > 0 THEN regr_r2(close, pos) {w(20)} END', 'close', 20)} AS r2 FROM f")
def rolling_linreg20(spark: SparkSession, sf: str) -> DataFrame:
    slope, r2 = rolling.linreg(F.col("close"), F.col("pos"), 20)
    return _frame(spark, sf).select("time", slope.alias("slope"), r2.alias("r2"))


_PAIR = "CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN {} END"
_A, _B = _PAIR.format("r"), _PAIR.format("r1")


@register(f"WITH {_LR}, l AS (SELECT *, lag(r) {W} AS r1 FROM f) SELECT time, CASE WHEN count({_A}) {w(50)} = 50 THEN covar_samp({_A}, {_B}) {w(50)} / nullif(stddev_samp({_A}) {w(50)} * stddev_samp({_B}) {w(50)}, 0) END AS autocorr FROM l")
def rolling_corr_lag1(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, sf).withColumn("r1", F.lag("r").over(series()))
    return rows.select("time", rolling.correlation(F.col("r"), F.col("r1"), 50).alias("autocorr"))


_RS = "greatest(ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)), 0)"
_K = 0.34 / (1.34 + 21 / 19)


@register(
    f"WITH {_LR} SELECT time, {g(f'stddev_samp(r) {w(20)}', 'r', 20)} * sqrt({BPY}) AS cc, {g(f'sqrt(avg(ln(high / low) * ln(high / low)) {w(20)} / (4 * ln(2)) * {BPY})', 'high', 20)} AS pk, "
    f"{g(f'sqrt(greatest(avg(0.5::DOUBLE * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open)) {w(20)}, 0) * {BPY})', 'high', 20)} AS gk, "
    f"{g(f'sqrt(avg({_RS}) {w(20)} * {BPY})', 'high', 20)} AS rs, {g(f'sqrt((var_samp(gap) {w(20)} + {_K!r}::DOUBLE * var_samp(ln(close / open)) {w(20)} + (1 - {_K!r}::DOUBLE) * avg({_RS}) {w(20)}) * {BPY})', 'gap', 20)} AS yz FROM f"
)
def range_volatilities(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, sf).select("time", rolling.close_to_close_vol(20, BPY).alias("cc"), rolling.parkinson_vol(20, BPY).alias("pk"), rolling.garman_klass_vol(20, BPY).alias("gk"), rolling.rogers_satchell_vol(20, BPY).alias("rs"), rolling.yang_zhang_vol(20, BPY).alias("yz"))


@register(
    f"WITH {_LR}, q AS (SELECT *, ln(close / lag(close, 4) {W}) AS r4 FROM f) SELECT time, CASE WHEN count(d) {w(20)} = 20 THEN coalesce(abs(close - lag(close, 20) {W}) / nullif(sum(abs(d)) {w(20)}, 0), 0) END AS er, "
    f"CASE WHEN count(r4) {w(60)} = 60 THEN var_samp(r4) {w(60)} / nullif(4 * var_samp(r) {w(60)}, 0) END AS vr4 FROM q"
)
def efficiency_variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, sf).withColumn("r4", rolling.log_return(F.col("close"), 4))
    return rows.select("time", rolling.efficiency_ratio(20, F.col("d"), F.col("close")).alias("er"), rolling.variance_ratio(4, 60, F.col("r"), F.col("r4")).alias("vr4"))


@register(f"WITH {BARS} SELECT b.time, CASE WHEN (SELECT count(*) FROM bars x WHERE x.time <= b.time) >= 100 THEN (SELECT (count(*) FILTER (WHERE y.close < b.close) + (count(*) FILTER (WHERE y.close = b.close) + 1) / 2.0::DOUBLE) / count(*) FROM (SELECT close FROM bars x WHERE x.time <= b.time ORDER BY time DESC LIMIT 100) y) END AS pct FROM bars b")
def percentile_rank100(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars(spark, sf).select("time", rolling.percentile_rank(F.col("close"), 100, 100).alias("pct"))


_SIGN = f"{_LR}, s AS (SELECT *, sign(r) AS sg FROM f), c AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) {W} OR row_number() {W} = 1 THEN 1 ELSE 0 END AS ch FROM s), n AS (SELECT *, sum(ch) {W} AS run FROM c)"


@register(f"WITH {_SIGN} SELECT time, (sg * row_number() OVER (PARTITION BY series_id, run ORDER BY time))::BIGINT AS streak FROM n")
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return islands.streaks(_frame(spark, sf), "r").select("time", "streak")


_GAP = "CASE WHEN h <= 1 THEN 'none' WHEN h >= 24 AND isodow(p) >= 5 THEN 'weekend' WHEN h <= 4 AND hour(p) BETWEEN 20 AND 23 THEN 'daily_break' ELSE 'intraweek' END"


@register(f"WITH {SERIES_BARS}, l AS (SELECT series_id, time, lag(time) {W} AS p FROM bars), k AS (SELECT *, date_diff('hour', p, time) AS h FROM l WHERE p IS NOT NULL) SELECT {_GAP} AS gap, count(*) AS n, max(h) AS longest_hours FROM k GROUP BY 1")
def gap_classes(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.operators.quality import classify_gap

    rows = T.bars(spark, sf, "1 day", by_series=True).select("time", F.lag("time").over(series()).alias("p")).filter("p IS NOT NULL")
    rows = rows.withColumn("h", F.timestamp_diff("HOUR", F.col("p"), F.col("time")))
    return rows.groupBy(classify_gap(F.col("p"), F.col("h")).alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("longest_hours"))


_Z = g(f"(close - avg(close) {w(20)}) / nullif(stddev_samp(close) {w(20)}, 0)", "close", 20)
_HOLD = "coalesce(last_value(CASE WHEN {} THEN 1 WHEN {} THEN 0 END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY time ROWS UNBOUNDED PRECEDING), 0)"


@register(f"WITH {BARS}, z AS (SELECT series_id, time, {_Z} AS z FROM bars) SELECT time, z, {_HOLD.format('z <= -2', 'z >= 0')} - {_HOLD.format('z >= 2', 'z <= 0')} AS position FROM z")
def latch_zscore_fade(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.bars(spark, sf).select("series_id", "time", rolling.zscore(F.col("close"), 20).alias("z"))
    z = F.col("z")
    return rows.select("time", "z", islands.latch(z <= -2, z >= 0, z >= 2, z <= 0).alias("position"))


@register(f"WITH {DAILY} SELECT date, equity, max(equity) OVER (ORDER BY date) AS peak, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM daily")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return dd.drawdowns(T.daily_totals(spark, sf))


@register(
    f"WITH {DAILY}, p AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM daily), a AS (SELECT *, CASE WHEN equity >= peak THEN date END AS ap FROM p), "
    "s AS (SELECT date, last_value(ap IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak_time, coalesce(first_value(ap IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(date) OVER ()) AS recovery_time FROM a) "
    "SELECT max(date_diff('day', peak_time, recovery_time))::INTEGER AS longest_days FROM s"
)
def drawdown_duration(spark: SparkSession, sf: str) -> DataFrame:
    return dd.drawdown_spells(T.daily_totals(spark, sf)).agg(F.max(F.datediff("recovery_time", "peak_time")).alias("longest_days"))


def _worst(n: int) -> str:
    f = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT {n} AS days, min(r) AS worst, arg_min(date, (r, date)) AS last_day FROM (SELECT date, CASE WHEN count(ret) {f} = {n} THEN exp(sum(ln(1 + ret)) {f}) - 1 END AS r FROM returns WHERE ret IS NOT NULL) WHERE r IS NOT NULL"


@register(f"WITH {RETURNS} " + " UNION ALL ".join(_worst(n) for n in (1, 5, 20)))
def worst_windows(spark: SparkSession, sf: str) -> DataFrame:
    return dd.worst_windows(dd.simple_returns(T.daily_totals(spark, sf)), [1, 5, 20])


@register(f"WITH {RETURNS} SELECT year(date)::INTEGER AS year, month(date)::INTEGER AS month, exp(sum(ln(1 + ret))) - 1 AS compounded, count(*) AS days FROM returns WHERE ret IS NOT NULL GROUP BY ROLLUP (year(date), month(date))")
def monthly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return dd.monthly_rollup(dd.simple_returns(T.daily_totals(spark, sf)))


@register(f"WITH {RETURNS} SELECT year(date)::INTEGER AS year, " + ", ".join(f"exp(sum(ln(1 + ret)) FILTER (WHERE month(date) = {m})) - 1 AS m{m}" for m in range(1, 13)) + " FROM returns WHERE ret IS NOT NULL GROUP BY 1")
def monthly_returns_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return dd.monthly_pivot(dd.simple_returns(T.daily_totals(spark, sf)))


@register(f"WITH {BARS}, l AS (SELECT *, lead(close, 12) {W} AS c2 FROM bars) SELECT time, ln(c2 / close) AS ret, CASE WHEN c2 IS NULL THEN NULL WHEN abs(ln(c2 / close)) > 0.5 THEN sign(ln(c2 / close))::DOUBLE ELSE 0.0 END AS label FROM l")
def fixed_horizon_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.fixed_horizon(T.bars(spark, sf), 12, 0.5).select("time", "ret", "label")


_TB = (
    f"{_LR}, v AS (SELECT *, (pos - 1)::INTEGER AS t, {g(f'stddev_samp(r) {w(20)}', 'r', 20)} AS trgt FROM f), e AS (SELECT *, close * exp(trgt) AS up, close * exp(-trgt) AS dn FROM v WHERE trgt > 0), "
    "j AS (SELECT e.time, e.t, e.close, e.up, e.dn, x.t AS xt, x.open AS xo, x.high AS xh, x.low AS xl, x.close AS xc FROM e JOIN v x ON x.t BETWEEN e.t + 1 AND e.t + 10), "
    "h AS (SELECT t, arg_min((xt, xo, xh, xl, xc), xt) AS hit FROM j WHERE xh >= up OR xl <= dn GROUP BY t), z AS (SELECT t, max(xc) FILTER (WHERE xt = t + 10) AS zc FROM j GROUP BY t), "
    "k AS (SELECT e.time, e.t, e.close, e.up, e.dn, hit[1] AS ht, hit[2] AS ho, hit[3] AS hh, hit[4] AS hl, hit[5] AS hc, zc, "
    "CASE WHEN hit IS NOT NULL AND hit[3] >= up AND hit[4] <= dn THEN CASE WHEN hit[2] >= up THEN 'pt' WHEN hit[2] <= dn THEN 'sl' ELSE 'ambiguous' END WHEN hit IS NOT NULL AND hit[3] >= up THEN 'pt' WHEN hit IS NOT NULL THEN 'sl' WHEN zc IS NOT NULL THEN 'vertical' ELSE 'incomplete' END AS b "
    "FROM e LEFT JOIN h USING (t) LEFT JOIN z USING (t)), p AS (SELECT *, CASE b WHEN 'pt' THEN greatest(up, ho) WHEN 'sl' THEN least(dn, ho) WHEN 'ambiguous' THEN hc ELSE zc END AS px FROM k)"
)
_TB_OUT = "t AS t_idx, coalesce(ht, CASE WHEN zc IS NOT NULL THEN t + 10 END)::INTEGER AS t1_idx, b AS barrier_hit, ln(px / close) AS ret, CASE b WHEN 'pt' THEN 1 WHEN 'sl' THEN -1 WHEN 'ambiguous' THEN 0 WHEN 'vertical' THEN sign(ln(px / close)) END::DOUBLE AS label"


def _barriers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _frame(spark, sf).withColumn("trgt", rolling.std(F.col("r"), 20))
    return labels.triple_barrier(rows, target="trgt", pt_mult=1.0, sl_mult=1.0, horizon=10)


@register(f"WITH {_TB} SELECT time AS t_event, {_TB_OUT} FROM p")
def triple_barrier(spark: SparkSession, sf: str) -> DataFrame:
    return _barriers(spark, sf).select("t_event", "t_idx", "t1_idx", "barrier_hit", "ret", "label")


_CONC = f"{_TB}, y AS (SELECT {_TB_OUT} FROM p), n AS (SELECT (pos - 1)::INTEGER AS pos FROM f), a AS (SELECT pos, (SELECT count(*) FROM y WHERE n.pos > t_idx AND n.pos <= t1_idx) AS active FROM n)"


@register(f"WITH {_CONC} SELECT pos, active FROM a")
def label_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    positions = T.bars(spark, sf).select("series_id", (F.row_number().over(series()) - 1).alias("pos"))
    return labels.concurrency(_barriers(spark, sf), positions).select("pos", "active")


@register(f"WITH {_CONC} SELECT t_idx, t1_idx, coalesce((SELECT avg(1.0::DOUBLE / active) FROM a WHERE a.pos > y.t_idx AND a.pos <= y.t1_idx), 1.0::DOUBLE) AS uniqueness FROM y WHERE t1_idx IS NOT NULL")
def label_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    positions = T.bars(spark, sf).select("series_id", (F.row_number().over(series()) - 1).alias("pos"))
    y = _barriers(spark, sf)
    return labels.uniqueness(y, labels.concurrency(y, positions)).select("t_idx", "t1_idx", "uniqueness")


@register(f"WITH {_TB}, y AS (SELECT {_TB_OUT} FROM p) SELECT t_idx, CASE barrier_hit WHEN 'pt' THEN 1 WHEN 'sl' THEN 0 WHEN 'vertical' THEN (ret > 0)::INTEGER END AS meta FROM y")
def meta_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.meta_labels(_barriers(spark, sf)).select("t_idx", "meta")


@register("SELECT user_id, coalesce(sum(value) / nullif(count(*) FILTER (WHERE event_type = 'error'), 0), -1.0::DOUBLE) AS value_per_error FROM events GROUP BY 1")
def safe_division(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("n"))
    return rows.select("user_id", safe_div(F.col("v"), F.col("n"), -1.0).alias("value_per_error"))
