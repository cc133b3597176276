"""Registered queries on the feature groups, managed and macro rules, simulated books and walk-forward; and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators import splits
from chronosift.plans import evidence, features, rules
from chronosift.plans.evidence import _VOL50, _before
from chronosift.plans.market import _H4, _H4_COMPLETE, _HOLD, _LR, _RS, BAR_COLS, BARS, BPY, CALENDAR, MACRO, W, g, w
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


def _group(spark: SparkSession, sf: str, name: str, **inputs) -> DataFrame:
    rows = features.GROUPS[name](T.bars(spark, sf), **inputs)
    return rows.select("time", *[c for c in rows.columns if c.startswith(f"{name}_")])


_ATR = f"src2 AS (SELECT time, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) {W} AS pc FROM bars)), an AS (SELECT time, tr AS x, row_number() OVER (ORDER BY time) AS i FROM src2 WHERE tr IS NOT NULL), arec AS (SELECT i, time, x::DOUBLE AS y FROM an WHERE i = 1 UNION ALL SELECT an.i, an.time, arec.y * (1 - {1 / 14!r}::DOUBLE) + {1 / 14!r}::DOUBLE * an.x FROM arec JOIN an ON an.i = arec.i + 1), atr AS (SELECT time, CASE WHEN i >= 14 THEN y END AS a FROM arec)"
_H = (1, 2, 3, 4, 6, 8, 12, 24, 48)


@register(f"{_VOL50} SELECT time, ln(close / lag(close) {W}) AS returns_log_1, {', '.join(f'ln(close / lag(close, {h}) {W}) / nullif(v * sqrt({h}.0::DOUBLE), 0) AS returns_z_{h}' for h in _H)} FROM bars LEFT JOIN vol USING (time)")
def features_returns(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "returns")


_Z3 = ", ".join(f"{g(f'(close - avg(close) {w(n)}) / nullif(stddev_samp(close) {w(n)}, 0)', 'close', n)} AS meanrev_z_{n}" for n in (20, 50, 100))


@register(
    f"WITH {BARS}, a AS (SELECT *, sign(ln(close / lag(close) {W}))::DOUBLE AS s FROM bars), b AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) {W} OR row_number() {W} = 1 THEN 1 ELSE 0 END AS ch FROM a), c AS (SELECT *, sum(ch) {W} AS run FROM b), "
    f"d AS (SELECT *, (s * row_number() OVER (PARTITION BY run ORDER BY time))::BIGINT AS streak FROM c) SELECT time, {_Z3}, {g(f'CASE WHEN stddev_pop(close) {w(20)} = 0 THEN 0 ELSE (close - avg(close) {w(20)}) / (2 * stddev_pop(close) {w(20)}) END', 'close', 20)} AS meanrev_pct_b, {g(f'CASE WHEN stddev_pop(close) {w(20)} = 0 THEN 0 ELSE 4 * stddev_pop(close) {w(20)} / avg(close) {w(20)} END', 'close', 20)} AS meanrev_width, streak AS meanrev_streak FROM d"
)
def features_meanrev(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "meanrev")


_DON = ", ".join(
    f"{g(f'(close - min(low) {w(n)}) / nullif(max(high) {w(n)} - min(low) {w(n)}, 0)', 'low', n)} AS range_pos_{n}, {g(f'(max(high) {w(n)} - min(low) {w(n)}) / nullif(a, 0)', 'low', n)} AS range_width_{n}" for n in (20, 55)
)


@register(
    f"WITH RECURSIVE {BARS}, {_ATR}, b AS (SELECT bars.*, a, high - low AS sz FROM bars LEFT JOIN atr USING (time)) SELECT time, {_DON}, coalesce((close - open) / nullif(sz, 0), 0) AS range_body, coalesce((high - greatest(open, close)) / nullif(sz, 0), 0) AS range_upper, coalesce((least(open, close) - low) / nullif(sz, 0), 0) AS range_lower, "
    f"coalesce((2 * close - high - low) / nullif(sz, 0), 0) AS range_clv, sz / nullif(a, 0) AS range_bar_atr, (high <= lag(high) {W} AND low >= lag(low) {W})::DOUBLE AS range_inside, (high > lag(high) {W} AND low < lag(low) {W})::DOUBLE AS range_outside, {g(f'(sz <= min(sz) {w(7)})::DOUBLE', 'sz', 7)} AS range_nr7 FROM b"
)
def features_range(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "range")


_MICRO = f"WITH RECURSIVE {BARS}, {_ATR}, b AS (SELECT bars.*, a, ln(spread) AS ls, ln(1 + volume) AS lv, ln(close / lag(close) {W}) AS r FROM bars LEFT JOIN atr USING (time)), c AS (SELECT *, lag(r) {W} AS r1 FROM b), d AS (SELECT *, CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN r END AS p, CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN r1 END AS q FROM c)"


@register(
    f"{_MICRO} SELECT time, spread * 10000 / close AS microstructure_spread_bps, {g(f'(ls - avg(ls) {w(100)}) / nullif(stddev_samp(ls) {w(100)}, 0)', 'ls', 100)} AS microstructure_spread_z, spread / nullif(a, 0) AS microstructure_spread_atr, {g(f'(lv - avg(lv) {w(100)}) / nullif(stddev_samp(lv) {w(100)}, 0)', 'lv', 100)} AS microstructure_volume_z, (open - lag(close) {W}) / nullif(a, 0) AS microstructure_gap_atr, "
    f"{g(f'covar_samp(p, q) {w(50)} / nullif(stddev_samp(p) {w(50)} * stddev_samp(q) {w(50)}, 0)', 'p', 50)} AS microstructure_autocorr FROM d"
)
def features_microstructure(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "microstructure")


def _vols(n: int) -> str:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return (
        f"{g(f'stddev_samp(r) {w(n)}', 'r', n)} * sqrt({BPY}) AS volatility_cc_{n}, {g(f'sqrt(avg(ln(high / low) * ln(high / low)) {w(n)} / (4 * ln(2)) * {BPY})', 'high', n)} AS volatility_pk_{n}, {g(f'sqrt(greatest(avg(0.5::DOUBLE * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open)) {w(n)}, 0) * {BPY})', 'high', n)} AS volatility_gk_{n}, "
        f"{g(f'sqrt(avg({_RS}) {w(n)} * {BPY})', 'high', n)} AS volatility_rs_{n}, {g(f'sqrt((var_samp(gap) {w(n)} + {k!r}::DOUBLE * var_samp(ln(close / open)) {w(n)} + (1 - {k!r}::DOUBLE) * avg({_RS}) {w(n)}) * {BPY})', 'gap', n)} AS volatility_yz_{n}"
    )


@register(
    f"{_VOL50}, {_ATR}, f AS (SELECT *, ln(close / lag(close) {W}) AS r, ln(open / lag(close) {W}) AS gap FROM bars), k AS (SELECT series_id, f.time, v * sqrt({BPY}) AS volatility_ewma, a / close AS volatility_atr_pct, {_vols(20)}, {_vols(60)} FROM f LEFT JOIN vol USING (time) LEFT JOIN atr USING (time)) "
    f"SELECT * EXCLUDE (series_id), CASE WHEN volatility_cc_20 > 0 THEN ln(volatility_cc_20 / nullif(volatility_cc_60, 0)) END AS volatility_ratio, {g(f'stddev_samp(volatility_cc_20) {w(60)}', 'volatility_cc_20', 60)} AS volatility_of_vol FROM k"
)
def features_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "volatility", bars_per_year=float(BPY))


_HR = lambda off: f"(hour(time + INTERVAL ({off}) HOUR) + minute(time) / 60.0::DOUBLE)"
_IN = lambda off, a, b: f"({_HR(off)} >= {a} AND {_HR(off)} < {b})::INTEGER::DOUBLE"


@register(
    f"WITH {BARS}, b AS (SELECT time, {_HR(0)} AS h, isodow(time) - 1 AS d FROM bars) SELECT time, sin(2 * {math.pi!r}::DOUBLE * h / 24) AS session_hour_sin, cos(2 * {math.pi!r}::DOUBLE * h / 24) AS session_hour_cos, sin(2 * {math.pi!r}::DOUBLE * (d * 24 + h) / 168) AS session_week_sin, cos(2 * {math.pi!r}::DOUBLE * (d * 24 + h) / 168) AS session_week_cos, "
    f"{_IN(9, 9, 18)} AS session_asia, {_IN(0, 8, 17)} AS session_london, {_IN(-5, 8, 17)} AS session_ny, {_IN(0, 8, 17)} * {_IN(-5, 8, 17)} AS session_overlap, {_IN(-5, 16, 18)} AS session_rollover, (isodow(time - INTERVAL 5 HOUR) = 5 AND {_HR(-5)} >= 12)::INTEGER::DOUBLE AS session_friday_late FROM b"
)
def features_session(spark: SparkSession, sf: str) -> DataFrame:
    """Clocks and sessions; the month of the table is in winter time throughout."""
    return _group(spark, sf, "session")


@register(
    f"WITH {BARS}, {CALENDAR}, c AS (SELECT DISTINCT time FROM calendar) SELECT b.time, least(coalesce((epoch_us(n.time) - epoch_us(b.time)) / 3600000000.0::DOUBLE, 72), 72) AS calendar_to_next, least(coalesce((epoch_us(b.time) - epoch_us(l.time)) / 3600000000.0::DOUBLE, 72), 72) AS calendar_since_last FROM bars b ASOF LEFT JOIN c n ON b.time <= n.time ASOF LEFT JOIN c l ON b.time > l.time"
)
def features_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "calendar", events=T.calendar(spark, sf))


_NAMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_KEY = lambda n: "".join(c if c.isalnum() else "_" for c in n.lower())


@register(
    f"WITH {BARS}, {MACRO}, m AS (SELECT *, ln(value / lag(value, 5) OVER (PARTITION BY name ORDER BY date)) AS change FROM macro) SELECT b.time, "
    + ", ".join(f"m{i}.value AS macro_{_KEY(n)}, m{i}.change AS macro_{_KEY(n)}_change" for i, n in enumerate(_NAMES))
    + " FROM bars b "
    + " ".join(f"ASOF LEFT JOIN (SELECT * FROM m WHERE name = '{n}') m{i} ON b.available_at >= m{i}.available_at" for i, n in enumerate(_NAMES))
)
def features_macro(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "macro", macro=T.macro(spark, sf))


_REGIME = f"WITH {_LR}, q AS (SELECT *, ln(close / lag(close, 4) {W}) AS r4 FROM f), v AS (SELECT *, {g(f'stddev_samp(r) {w(20)}', 'r', 20)} AS v FROM q)"


@register(
    f"{_REGIME}, rk AS (SELECT a.time, CASE WHEN a.v IS NOT NULL AND count(b.v) >= 100 THEN (count(*) FILTER (WHERE b.v < a.v) + (count(*) FILTER (WHERE b.v = a.v) + 1) / 2.0::DOUBLE) / count(b.v) END AS rank FROM (SELECT *, row_number() {W} AS i FROM v) a JOIN (SELECT *, row_number() {W} AS i FROM v) b ON b.i BETWEEN a.i - 499 AND a.i GROUP BY a.time, a.v) "
    f"SELECT time, rank AS regime_vol_rank, (rank > 0.8)::INTEGER::DOUBLE AS regime_high_vol, (rank < 0.2)::INTEGER::DOUBLE AS regime_low_vol, CASE WHEN count(d) {w(20)} = 20 THEN coalesce(abs(close - lag(close, 20) {W}) / nullif(sum(abs(d)) {w(20)}, 0), 0) END AS regime_er, CASE WHEN count(r4) {w(60)} = 60 THEN var_samp(r4) {w(60)} / nullif(4 * var_samp(r) {w(60)}, 0) END AS regime_vr FROM v JOIN (SELECT time AS rt, rank FROM rk) ON rt = time"
)
def features_regime(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "regime")


def _chain(name: str, rows: str, alpha: float, least: int) -> str:
    """CTEs for a recursive average `name` (time, v) of rows (time, x), null until `least` values."""
    return (
        f"{name}_n AS MATERIALIZED (SELECT time, x, row_number() OVER (ORDER BY time) AS i FROM ({rows}) WHERE x IS NOT NULL), {name}_r AS (SELECT i, time, x::DOUBLE AS y FROM {name}_n WHERE i = 1 UNION ALL SELECT {name}_n.i, {name}_n.time, {name}_r.y * (1 - {alpha!r}::DOUBLE) + {alpha!r}::DOUBLE * {name}_n.x FROM {name}_r JOIN {name}_n ON {name}_n.i = {name}_r.i + 1), "
        f"{name} AS MATERIALIZED (SELECT time, CASE WHEN i >= {least} THEN y END AS v FROM {name}_r)"
    )


def _rsi(name: str, bars: str, n: int) -> str:
    d = f"SELECT time, close - lag(close) {W} AS d FROM {bars}"
    return f"{_chain(name + 'u', f'SELECT time, greatest(d, 0) AS x FROM ({d}) WHERE d IS NOT NULL', 1 / n, n)}, {_chain(name + 'd', f'SELECT time, greatest(-d, 0) AS x FROM ({d}) WHERE d IS NOT NULL', 1 / n, n)}, {name} AS (SELECT a.time, CASE WHEN a.v + b.v = 0 THEN 50 ELSE 100 * a.v / (a.v + b.v) END AS v FROM {name}u a JOIN {name}d b USING (time))"


def _tr(bars: str) -> str:
    return f"SELECT time, greatest(high - low, abs(high - pc), abs(low - pc)) AS x FROM (SELECT *, lag(close) {W} AS pc FROM {bars})"


_STO = g(f"coalesce(100 * (close - min(low) {w(14)}) / nullif(max(high) {w(14)} - min(low) {w(14)}, 0), 50)", "low", 14)
_MZ = ", ".join(f"ln(close / lag(close, {h}) {W}) / nullif(vv.v * sqrt({h}.0::DOUBLE), 0) AS z{h}" for h in (24, 48, 120))


@register(
    f"WITH RECURSIVE {BARS}, {_chain('vq', f'SELECT time, pow(ln(close / lag(close) {W}), 2) AS x FROM bars', 1 - 0.5 ** (1 / 50), 20)}, vv AS (SELECT time, sqrt(v) AS v FROM vq), {_rsi('ra', 'bars', 2)}, {_rsi('rb', 'bars', 14)}, "
    f"m AS (SELECT bars.series_id, bars.time, ra.v AS r2, rb.v AS r14, {_MZ.replace('PARTITION BY series_id ORDER BY time', 'PARTITION BY bars.series_id ORDER BY bars.time')}, ln(close / lag(close) OVER (PARTITION BY bars.series_id ORDER BY bars.time)) AS r, {_STO.replace('PARTITION BY series_id ORDER BY time', 'PARTITION BY bars.series_id ORDER BY bars.time')} AS k FROM bars LEFT JOIN vv ON vv.time = bars.time LEFT JOIN ra ON ra.time = bars.time LEFT JOIN rb ON rb.time = bars.time), "
    f"u AS (SELECT *, CASE WHEN r IS NOT NULL THEN (r > 0)::INTEGER::DOUBLE END AS up FROM m) SELECT time, r2 AS momentum_rsi_2, r14 AS momentum_rsi_14, k AS momentum_stoch_k, {', '.join(f'z{h} AS momentum_z_{h}, z{h} * exp(-z{h} * z{h} / 4) / 0.89::DOUBLE AS momentum_resp_{h}' for h in (24, 48, 120))}, {g(f'avg(k) {w(3)}', 'k', 3)} AS momentum_stoch_d, {g(f'avg(up) {w(20)}', 'up', 20)} AS momentum_up_frac FROM u"
)
def features_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "momentum")


@register(
    f"WITH RECURSIVE {BARS}, {_H4}, h AS ({_H4_COMPLETE}), {_chain('hv', f'SELECT time, pow(ln(close / lag(close) {W}), 2) AS x FROM h', 1 - 0.5 ** (1 / 20), 10)}, {_rsi('hr', 'h', 14)}, {_chain('he', 'SELECT time, close AS x FROM h', 2 / 21, 20)}, {_chain('ha', _tr('h'), 1 / 14, 14)}, "
    f"j AS (SELECT h.series_id, h.time, available_at, close, high, low, ln(close / lag(close) OVER (ORDER BY h.time)) / nullif(sqrt(hv.v), 0) AS mtf_ret_z, hr.v AS mtf_rsi, (close - he.v) / nullif(ha.v, 0) AS mtf_dist FROM h LEFT JOIN hv ON hv.time = h.time LEFT JOIN hr ON hr.time = h.time LEFT JOIN he ON he.time = h.time LEFT JOIN ha ON ha.time = h.time), "
    f"k AS (SELECT *, {g(f'(close - min(low) {w(20)}) / nullif(max(high) {w(20)} - min(low) {w(20)}, 0)', 'low', 20)} AS mtf_pos FROM j) SELECT b.time, mtf_ret_z, mtf_rsi, mtf_dist, mtf_pos FROM bars b ASOF LEFT JOIN k ON b.available_at >= k.available_at"
)
def features_mtf(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "mtf")


_UD = f"SELECT *, high - lag(high) {W} AS up, -(low - lag(low) {W}) AS dn FROM bars"
_SPANS = (20, 50, 100)
_EMAS = ", ".join(_chain(f"e{n}", "SELECT time, close AS x FROM bars", 2 / (n + 1), n) for n in _SPANS)
_ADX = (
    f"{_chain('pa', f'SELECT time, CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0 END AS x FROM ({_UD})', 1 / 14, 14)}, {_chain('pb', f'SELECT time, CASE WHEN dn IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS x FROM ({_UD})', 1 / 14, 14)}, {_chain('ax', _tr('bars'), 1 / 14, 14)}, "
    f"di AS (SELECT ax.time, 100 * pa.v / ax.v AS p, 100 * pb.v / ax.v AS m FROM ax LEFT JOIN pa ON pa.time = ax.time LEFT JOIN pb ON pb.time = ax.time), {_chain('ad', 'SELECT time, CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS x FROM di', 1 / 14, 14)}"
)
_MACD = f"{_chain('mf', 'SELECT time, close AS x FROM bars', 2 / 13, 12)}, {_chain('ms', 'SELECT time, close AS x FROM bars', 2 / 27, 26)}, ml AS (SELECT time, mf.v - ms.v AS l FROM mf JOIN ms USING (time)), {_chain('mg', 'SELECT time, l AS x FROM ml', 2 / 10, 9)}"


@register(
    f"WITH RECURSIVE {BARS}, {_EMAS}, {_ADX}, {_MACD}, t AS (SELECT bars.series_id, bars.time AS time, close, row_number() OVER (ORDER BY bars.time) AS pos, ax.v AS a, e20.v AS e20, e50.v AS e50, e100.v AS e100, ad.v AS adx, p - m AS did, l, mg.v AS sg FROM bars LEFT JOIN ax ON ax.time = bars.time LEFT JOIN e20 ON e20.time = bars.time LEFT JOIN e50 ON e50.time = bars.time LEFT JOIN e100 ON e100.time = bars.time LEFT JOIN ad ON ad.time = bars.time LEFT JOIN di ON di.time = bars.time LEFT JOIN ml ON ml.time = bars.time LEFT JOIN mg ON mg.time = bars.time) "
    f"SELECT time, adx AS trend_adx, did AS trend_di_diff, l / nullif(a, 0) AS trend_macd_line, sg / nullif(a, 0) AS trend_macd_signal, (l - sg) / nullif(a, 0) AS trend_macd_hist, {', '.join(f'(close - e{n}) / nullif(a, 0) AS trend_dist_{n}, (e{n} - lag(e{n}, 5) {W}) / nullif(a, 0) AS trend_slope_{n}' for n in _SPANS)}, "
    + ", ".join(f"{g(f'regr_slope(close, pos) {w(n)}', 'close', n)} * {n} / nullif(a, 0) AS trend_lin_t_{n}, {g(f'CASE WHEN var_pop(close) {w(n)} > 0 THEN regr_r2(close, pos) {w(n)} END', 'close', n)} AS trend_lin_r2_{n}" for n in _SPANS)
    + " FROM t"
)
def features_trend(spark: SparkSession, sf: str) -> DataFrame:
    return _group(spark, sf, "trend")


_ALL = [k for k in _SQL if k.startswith("features_")]
_SQL["feature_matrix"] = f"SELECT b.*, {', '.join(f'{k}.* EXCLUDE (time)' for k in _ALL)} FROM (WITH {BARS} SELECT {BAR_COLS} FROM bars) b " + " ".join(f"JOIN ({_SQL[k]}) {k} ON {k}.time = b.time" for k in _ALL)


# ---- rules on other inputs ---------------------------------------------------
@register(
    f"WITH {BARS}, {MACRO}, m AS (SELECT *, ln(value / lag(value, 20) OVER (PARTITION BY name ORDER BY date)) AS c FROM macro), z AS (SELECT *, CASE WHEN count(c) OVER k = 60 THEN c / nullif(stddev_samp(c) OVER k, 0) END AS z FROM m WINDOW k AS (PARTITION BY name ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), "
    "j AS (SELECT b.time, -u.z AS a, h.z AS c FROM bars b ASOF LEFT JOIN (SELECT * FROM z WHERE name = '1-URGENT') u ON b.available_at >= u.available_at ASOF LEFT JOIN (SELECT * FROM z WHERE name = '2-HIGH') h ON b.available_at >= h.available_at) "
    "SELECT time, greatest(least(CASE WHEN a IS NULL AND c IS NULL THEN 0 ELSE (coalesce(a, 0) + coalesce(c, 0)) / sqrt((a IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER) END / 2, 1), -1)::DOUBLE AS macro_factor FROM j"
)
def rule_macro_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rules.macro_factor(T.bars(spark, sf), T.macro(spark, sf), {"1-URGENT": -1.0, "2-HIGH": 1.0}).select("time", (F.col("macro_factor") + 0.0).alias("macro_factor"))


def _ewm(alpha: float, src: str, name: str) -> str:
    return f"{name} AS (SELECT i, time, x::DOUBLE AS y FROM {src} WHERE i = 1 UNION ALL SELECT {src}.i, {src}.time, {name}.y * (1 - {alpha!r}::DOUBLE) + {alpha!r}::DOUBLE * {src}.x FROM {name} JOIN {src} ON {src}.i = {name}.i + 1)"


@register(
    f"WITH RECURSIVE {BARS}, c1 AS (SELECT time, close AS x, row_number() OVER (ORDER BY time) AS i FROM bars), c2 AS (SELECT time, x, row_number() OVER (ORDER BY time) AS i FROM (SELECT time, pow(ln(close / lag(close) {W}), 2) AS x FROM bars) WHERE x IS NOT NULL), {_ewm(2 / 101, 'c1', 'e1')}, {_ewm(1 - 0.5 ** (1 / 20), 'c2', 'v1')}, {_ewm(1 - 0.5 ** (1 / 200), 'c2', 'v2')}, "
    "b AS (SELECT series_id, bars.time, close, CASE WHEN e1.i >= 100 THEN e1.y END AS e, CASE WHEN v1.i >= 10 THEN sqrt(v1.y) END / nullif(CASE WHEN v2.i >= 50 THEN sqrt(v2.y) END, 0) AS q FROM bars LEFT JOIN e1 ON e1.time = bars.time LEFT JOIN v1 ON v1.time = bars.time LEFT JOIN v2 ON v2.time = bars.time) "
    f"SELECT time, 0.5::DOUBLE * CASE WHEN {_HOLD.format('close < e AND q > 1.2', 'close > e OR q < 0.9')} = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS managed FROM b"
)
def rule_managed(spark: SparkSession, sf: str) -> DataFrame:
    return rules.managed(T.bars(spark, sf)).select("time", "managed")


_KEYED = f"kb AS (SELECT *, lead(open) {W} AS no, lead(close) {W} AS nc, lead(time) {W} AS nt FROM bars), tr AS (SELECT ln(nc / no) AS y, (isodow(nt - INTERVAL 5 HOUR) - 1) * 24 + hour(nt - INTERVAL 5 HOUR) AS key FROM (SELECT *, lead(open) {W} AS no, lead(close) {W} AS nc, lead(time) {W} AS nt FROM bars WHERE time < TIMESTAMP '2024-01-22'))"


@register(
    f"{_VOL50}, {_KEYED}, ks AS (SELECT key, count(y) AS n, avg(y) AS mean, var_samp(y) AS var FROM tr WHERE y IS NOT NULL GROUP BY 1 HAVING count(y) > 1 AND var_samp(y) > 0), kw AS (SELECT *, n / var AS wt FROM ks), kt AS (SELECT sum(wt) AS w1, sum(wt * wt) AS w2, sum(wt * mean) / sum(wt) AS grand, count(*) AS k FROM kw), kq AS (SELECT sum(wt * (mean - grand) * (mean - grand)) AS q FROM kw, kt), "
    "ku AS (SELECT greatest(0, coalesce((q - (k - 1)) / nullif(w1 - w2 / w1, 0), 0)) AS tau2, grand FROM kt, kq), kf AS (SELECT key, grand + coalesce(tau2 / nullif(tau2 + var / n, 0), 0) * (mean - grand) AS shrunk FROM kw, ku) "
    "SELECT bars.time, greatest(least(coalesce(shrunk / nullif(v, 0), 0) * 20, 1), -1)::DOUBLE AS intraday_seasonality FROM bars LEFT JOIN vol ON vol.time = bars.time LEFT JOIN kf ON kf.key = (isodow(available_at - INTERVAL 5 HOUR) - 1) * 24 + hour(available_at - INTERVAL 5 HOUR)"
)
def rule_seasonality(spark: SparkSession, sf: str) -> DataFrame:
    """The shrunken mean of the next New York hour of the week over volatility (winter time throughout)."""
    rows = T.bars(spark, sf)
    fitted = rules.fit_seasonality(rows.filter("time < TIMESTAMP_NTZ '2024-01-22'"))
    return rules.seasonality(rows, fitted).select("time", (F.col("intraday_seasonality") + 0.0).alias("intraday_seasonality"))


# ---- splits ------------------------------------------------------------------
@register(
    "WITH n AS (SELECT count(*) AS n FROM customer), e AS (SELECT g::INTEGER AS g, g * (n // 5) + least(g, n % 5) AS a, (g + 1) * (n // 5) + least(g + 1, n % 5) AS b FROM n, range(5) r(g)), c AS (SELECT x.g AS p, y.g AS q, (row_number() OVER (ORDER BY x.g, y.g) - 1)::INTEGER AS combo FROM e x JOIN e y ON x.g < y.g) "
    "SELECT combo, e.g AS grp, a AS first, b AS stop FROM c JOIN e ON e.g = p OR e.g = q"
)
def cpcv_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Test groups of every combination of two of five."""
    n = T.table(spark, sf, "customer").count()
    rows = [(c["combo"], g_, a, b) for c in splits.cpcv(n, 5, 2) for g_, (a, b) in zip(c["groups"], c["spans"], strict=True)]
    return spark.createDataFrame(rows, "combo int, grp int, first long, stop long")


@register(
    "WITH e AS (SELECT g FROM range(5) r(g)), c AS (SELECT x.g AS p, y.g AS q, row_number() OVER (ORDER BY x.g, y.g) - 1 AS combo FROM e x JOIN e y ON x.g < y.g), s AS (SELECT e.g, combo, row_number() OVER (PARTITION BY e.g ORDER BY combo) - 1 AS path FROM c JOIN e ON e.g = p OR e.g = q) SELECT path::INTEGER AS path, g::INTEGER AS grp, combo::INTEGER AS combo FROM s"
)
def cpcv_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Which combination predicts each group on every path."""
    rows = [(p, g_, c) for p, path in enumerate(splits.cpcv_paths(5, 2)) for g_, c in enumerate(path)]
    return spark.createDataFrame(rows, "path int, grp int, combo int")




# ---- the same, under the names of the first queries --------------------------
_SQL["seasonality_forecast"] = _SQL["rule_seasonality"]
_SQL["macro_forecast"] = _SQL["rule_macro_factor"]
_SQL["managed_allocation"] = _SQL["rule_managed"]
_SQL["opening_range_breakout"] = evidence._SQL["rule_orb"]
_SQL["sweep_zscore_fade"] = evidence._SQL["sweep_grid"]


def _walk_forward_sql() -> str:
    """Donchian, z-score and band rules, weighted by each fold's training ratios, as one stitched book."""
    don = f"{_HOLD.format('da', 'dx')} - {_HOLD.format('dc', 'dy')}"
    zf = f"{_HOLD.format('z <= -2', 'z >= 0')} - {_HOLD.format('z >= 2', 'z <= 0')}"
    bb = f"{_HOLD.format('py < -2 AND pz >= -2', 'pz >= 0 OR pz < -3.5')} - {_HOLD.format('py > 2 AND pz <= 2', 'pz <= 0 OR pz > 3.5')}"
    names = ("donchian", "zscore_fade", "bollinger_revert")
    sr = ", ".join(f"coalesce(avg({n} * nx) / nullif(stddev_samp({n} * nx), 0), 0) AS {n}" for n in names)
    up = " + ".join(f"greatest(w.{n}, 0)" for n in names)
    share = ", ".join(f"CASE WHEN {up} > 0 THEN greatest(w.{n}, 0) / ({up}) ELSE 1 / 3.0::DOUBLE END AS w_{n}" for n in names)
    total = " + ".join(f"s.{n} * w_{n}" for n in names)
    return (
        f"WITH {BARS}, b1 AS (SELECT *, close > {_before('high', 55, 'max')} AS da, close < {_before('low', 20, 'min')} AS dx, close < {_before('low', 55, 'min')} AS dc, close > {_before('high', 20, 'max')} AS dy, {g(f'(close - avg(close) {w(20)}) / nullif(stddev_samp(close) {w(20)}, 0)', 'close', 20)} AS z, {g(f'(close - avg(close) {w(20)}) / nullif(stddev_pop(close) {w(20)}, 0)', 'close', 20)} AS pz, ln(lead(close) {W} / close) AS nx, row_number() {W} - 1 AS pos, count(*) OVER () AS nb FROM bars), "
        f"b2 AS (SELECT *, lag(pz) {W} AS py FROM b1), s AS (SELECT series_id, time, open, high, low, close, spread, nx, pos, nb, ({don})::DOUBLE AS donchian, ({zf})::DOUBLE AS zscore_fade, ({bb})::DOUBLE AS bollinger_revert FROM b2), "
        "f AS (SELECT k::INTEGER AS fold, k * 100 AS a, 200 + k * 100 AS b, 204 + k * 100 AS c, least(304 + k * 100, nb) AS d FROM (SELECT max(nb) AS nb FROM s), range(200) r(k) WHERE 204 + k * 100 < nb), "
        f"w AS (SELECT fold, {sr} FROM s JOIN f ON pos >= a AND pos < b - 1 GROUP BY 1), v AS (SELECT fold, {share} FROM w), "
        f"t AS (SELECT s.*, fold, {total} AS combined FROM s JOIN f ON pos >= c AND pos < d JOIN v USING (fold)), "
        f"pa AS (SELECT *, coalesce(lag(combined) {W}, 0) AS position, coalesce(lag(combined, 2) {W}, 0) AS prior, coalesce(lag(close) {W}, open) AS pc FROM t), pb AS (SELECT *, abs(position - prior) AS traded FROM pa), "
        f"pd AS (SELECT *, 100 * (prior * (open - pc) + position * (close - open)) - CASE WHEN traded > 0 THEN traded * 100 * (spread / 2 + 0.02::DOUBLE + 0.05::DOUBLE * (high - low)) + traded * 3.5::DOUBLE ELSE 0.0 END AS pnl FROM pb) SELECT time, fold, combined, position, pnl, 100000 + sum(pnl) {W} AS equity FROM pd"
    )


_SQL["walk_forward_book"] = _walk_forward_sql()
_SQL["cusum_events"] = (
    f"WITH RECURSIVE {BARS}, n AS (SELECT time, ln(close / lag(close) {W}) AS r, row_number() {W} AS i FROM bars), rec AS (SELECT i, time, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0.0::DOUBLE AS event FROM n WHERE i = 1 UNION ALL "
    "SELECT i, time, CASE WHEN u > 2 OR d < -2 THEN 0.0 ELSE u END::DOUBLE, CASE WHEN u > 2 OR d < -2 THEN 0.0 ELSE d END::DOUBLE, CASE WHEN u > 2 THEN 1.0 WHEN d < -2 THEN -1.0 ELSE 0.0 END::DOUBLE FROM (SELECT n.i, n.time, greatest(0, rec.up + n.r)::DOUBLE AS u, least(0, rec.dn + n.r)::DOUBLE AS d FROM rec JOIN n ON n.i = rec.i + 1)) SELECT time, event FROM rec WHERE event <> 0"
)
