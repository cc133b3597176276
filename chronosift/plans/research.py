"""Registered queries on returns, risk, splits, execution, features, rules and JSON; and their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.functions import ewm
from chronosift.functions.scalars import normal_quantile
from chronosift.operators import drawdown as dd
from chronosift.operators import execution, quality, risk, rolling, splits
from chronosift.operators.positions import numbered
from chronosift.operators.rolling import series
from chronosift.plans import features, rules
from chronosift.plans.market import BARS, CALENDAR, DAILY, MACRO, RETURNS, SERIES_BARS, W
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


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return dd.simple_returns(T.daily_totals(spark, sf)).filter("ret IS NOT NULL")


PERF = "perf AS (SELECT name, date, value / lag(value) OVER (PARTITION BY name ORDER BY date) - 1 AS ret FROM (SELECT o_orderpriority AS name, o_orderdate::DATE AS date, sum(o_totalprice) AS value FROM orders GROUP BY ALL))"


def _perf(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    return rows.select("name", "date", (F.col("value") / F.lag("value").over(Window.partitionBy("name").orderBy("date")) - 1).alias("ret")).filter("ret IS NOT NULL")


@register(f"WITH {RETURNS}, q AS (SELECT quantile_cont(ret, 0.05) AS q FROM returns WHERE ret IS NOT NULL) SELECT -q AS var, greatest(-(SELECT avg(ret) FROM returns WHERE ret <= q), -q) AS es FROM q")
def var_es_historical(spark: SparkSession, sf: str) -> DataFrame:
    return risk.var_es(_returns(spark, sf), 0.95)


_Z = normal_quantile(0.05)
_D = 0.3989422804014327 * 2.718281828459045 ** (-_Z * _Z / 2)


@register(f"WITH {RETURNS} SELECT -(avg(ret) + {_Z!r}::DOUBLE * stddev_samp(ret)) AS var, -(avg(ret) - {_D!r}::DOUBLE / 0.05::DOUBLE * stddev_samp(ret)) AS es FROM returns")
def var_es_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return risk.var_es(_returns(spark, sf), 0.95, method="gaussian")


@register(f"WITH {RETURNS}, q AS (SELECT ret, CASE WHEN count(ret) OVER f = 250 THEN quantile_cont(ret, 0.05) OVER f END AS q FROM returns WHERE ret IS NOT NULL WINDOW f AS (ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) SELECT count(*) AS n, count(*) FILTER (WHERE ret < q) AS breaches FROM q WHERE q IS NOT NULL")
def var_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return risk.rolling_var_breaches(_returns(spark, sf), 0.95, 250)


_POWER = "n, s / n AS mean, sqrt((ss - s * s / n) / (n - 1)) AS sd, (sss - 3 * s / n * ss + 2 * s * s * s / (n * n)) / n / pow((ss - s * s / n) / n, 1.5) AS skew, (ssss - 4 * s / n * sss + 6 * s * s / (n * n) * ss - 3 * s * s * s * s / (n * n * n)) / n / pow((ss - s * s / n) / n, 2) AS kurt"


@register(f"WITH {RETURNS}, p AS (SELECT count(ret)::DOUBLE AS n, sum(ret) AS s, sum(ret * ret) AS ss, sum(ret * ret * ret) AS sss, sum(ret * ret * ret * ret) AS ssss FROM returns) SELECT {_POWER} FROM p")
def return_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Biased skewness and Pearson kurtosis, from power sums."""
    x = F.col("ret")
    sums = _returns(spark, sf).agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.sum(x * x * x).alias("sss"), F.sum(x * x * x * x).alias("ssss"))
    return sums.selectExpr(*_POWER.replace(", s /", "|s /").replace(", sqrt", "|sqrt").replace(", (sss ", "|(sss ").replace(", (ssss", "|(ssss").split("|"))


@register(f"WITH {PERF}, d AS (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM perf WHERE ret IS NOT NULL)) SELECT name, block, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM perf JOIN d USING (date) WHERE ret IS NOT NULL GROUP BY ALL")
def pbo_block_sums(spark: SparkSession, sf: str) -> DataFrame:
    return risk.block_sums(_perf(spark, sf), 8).withColumn("block", F.col("block").cast("long"))


_COMBOS = ",".join(f"({i},{b},{int(b in c)})" for i, c in enumerate(itertools.combinations(range(8), 4)) for b in range(8))
_SR = "(sum(s) FILTER (WHERE inside = {0}) / sum(n) FILTER (WHERE inside = {0})) / sqrt((sum(ss) FILTER (WHERE inside = {0}) - pow(sum(s) FILTER (WHERE inside = {0}), 2) / sum(n) FILTER (WHERE inside = {0})) / (sum(n) FILTER (WHERE inside = {0}) - 1))"


@register(
    f"WITH {PERF}, d AS (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM perf WHERE ret IS NOT NULL)), b AS (SELECT name, block, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM perf JOIN d USING (date) WHERE ret IS NOT NULL GROUP BY ALL), "
    f"c(combo, block, inside) AS (VALUES {_COMBOS}), x AS (SELECT combo, name, {_SR.format(1)} AS is_sr, {_SR.format(0)} AS oos_sr FROM b JOIN c USING (block) GROUP BY ALL), "
    "r AS (SELECT *, (rank() OVER (PARTITION BY combo ORDER BY oos_sr) - 1 + (count(*) OVER (PARTITION BY combo, oos_sr) + 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY combo) + 1) AS w, row_number() OVER (PARTITION BY combo ORDER BY is_sr DESC, name) AS best FROM x) "
    "SELECT combo, name AS chosen, is_sr, oos_sr, w, ln(w / (1 - w)) AS logit FROM r WHERE best = 1"
)
def pbo_cscv(spark: SparkSession, sf: str) -> DataFrame:
    return risk.pbo(risk.block_sums(_perf(spark, sf), 8), 8)


_P = "SELECT user_id AS name, least(1.0::DOUBLE, (1 + count(*) FILTER (WHERE value > 300))::DOUBLE / count(*)) AS p FROM events GROUP BY 1"


@register(f"WITH t AS ({_P}), k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, name) AS k FROM t) SELECT name, p, least(p * m, 1) AS bonferroni, least(max(p * (m - k + 1)) OVER (ORDER BY p, name), 1) AS holm, least(min(p * m / k) OVER (ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bh FROM k")
def adjust_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "events").groupBy(F.col("user_id").alias("name")).agg(F.least(F.lit(1.0), (1 + F.count_if(F.col("value") > 300)).cast("double") / F.count(F.lit(1))).alias("p"))
    return risk.adjust_pvalues(rows)


@register("SELECT c_custkey AS id, s.shock, c_acctbal / 100 * 100 * 20 * s.shock AS pnl, 100000.0::DOUBLE + c_acctbal / 100 * 100 * 20 * s.shock AS equity_after FROM customer, (VALUES (-0.1::DOUBLE), (-0.05), (0.05), (0.1)) s(shock)")
def gap_shocks(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("lots"), F.lit(20.0).alias("price"), F.lit(100_000.0).alias("equity"))
    return risk.gap_shocks(p, [-0.1, -0.05, 0.05, 0.1]).select("id", "shock", "pnl", "equity_after")


@register(
    f"WITH {DAILY}, x AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM daily), f AS (SELECT k::INTEGER AS fold, k * 250 AS a, 500 + k * 250 AS b, 515 + k * 250 AS c, least(765 + k * 250, n) AS d FROM (SELECT max(n) AS n FROM x), range(1000) r(k) WHERE 515 + k * 250 < n) SELECT fold, CASE WHEN pos < b THEN 'train' ELSE 'test' END AS part, pos FROM x JOIN f ON pos >= a AND pos < b OR pos >= c AND pos < d"
)
def walk_forward_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Folds over all days, planned from their number."""
    pos = T.daily_totals(spark, sf).select((F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("pos"))
    return splits.membership(pos, splits.folds_frame(spark, splits.walk_forward(pos.count(), 500, 250, purge=10, embargo=5)))


@register("WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS t, 1 + o_orderkey % 7 AS h FROM orders), n AS (SELECT count(*) AS n FROM l), f AS (SELECT k::INTEGER AS fold, k * (n // 5) + least(k, n % 5) AS a, (k + 1) * (n // 5) + least(k + 1, n % 5) AS b FROM n, range(5) r(k)) SELECT fold, t AS pos FROM l JOIN f ON NOT (t < b + 3 AND t + h >= a)")
def purged_kfold_train(spark: SparkSession, sf: str) -> DataFrame:
    rows = numbered(T.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "t_idx").select("t_idx", (1 + F.col("o_orderkey") % 7).alias("h"))
    return splits.purged_kfold(rows.withColumn("t1_idx", F.col("t_idx") + F.col("h")), rows.count(), 5, embargo=3)


@register("SELECT a, b, c FROM (VALUES (10), (20), (40)) x(a), (VALUES (0.5::DOUBLE), (1.0)) y(b), (VALUES ('ema'), ('sma')) z(c)")
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grid(spark, {"a": [10, 20, 40], "b": [0.5, 1.0], "c": ["ema", "sma"]})


_LOTS = "CASE WHEN seq % 7 < 3 THEN 1.0::DOUBLE WHEN seq % 7 < 5 THEN -1.0 ELSE 0.0 END"
_TARGETS = f"{BARS}, s AS (SELECT date_trunc('hour', time) AS time, arg_max(seq, (time, seq)) AS seq FROM ticks GROUP BY 1), t AS (SELECT b.*, {_LOTS} AS target FROM bars b JOIN s USING (time))"
_PATH = (
    f"p AS (SELECT *, coalesce(lag(target) {W}, 0) AS position, coalesce(lag(target, 2) {W}, 0) AS prior, coalesce(lag(close) {W}, open) AS pc FROM t), "
    "q AS (SELECT *, abs(position - prior) AS traded FROM p), c AS (SELECT *, CASE WHEN traded > 0 THEN traded * 100 * (spread / 2 + 0.02::DOUBLE + 0.05::DOUBLE * (high - low)) + traded * 3.5::DOUBLE ELSE 0.0 END AS cost, 100 * (prior * (open - pc) + position * (close - open)) AS gross FROM q) "
    f"SELECT time, position, cost, gross, gross - cost AS pnl, 100000 + sum(gross - cost) {W} AS equity FROM c"
)
COSTS = execution.Costs(slip_fixed=0.02, slip_range=0.05)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    seq = T.ticks(spark, sf).groupBy(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).agg((F.max_by("seq", F.struct("time", "seq")) % 7).alias("m"))
    return T.bars(spark, sf).join(seq, "time").withColumn("lots", F.when(F.col("m") < 3, 1.0).when(F.col("m") < 5, -1.0).otherwise(0.0))


@register(f"WITH {_TARGETS}, {_PATH}")
def target_lots_pnl(spark: SparkSession, sf: str) -> DataFrame:
    return execution.target_lots_pnl(_targets(spark, sf), "lots", COSTS).select("time", "position", "cost", "gross", "pnl", "equity")


@register(f"WITH {BARS}, t AS (SELECT *, 2.0::DOUBLE AS target FROM bars), {_PATH}")
def buy_and_hold(spark: SparkSession, sf: str) -> DataFrame:
    return execution.buy_and_hold(T.bars(spark, sf), 2.0, COSTS).select("time", "position", "cost", "gross", "pnl", "equity")


@register(
    "WITH e AS (SELECT event_id, ts AS a, ts + to_hours((event_id % 200)::BIGINT) AS b FROM events), d AS (SELECT x + INTERVAL 21 HOUR AS r, sum(CASE isodow(x) WHEN 3 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END) OVER (ORDER BY x) AS upto FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-03-01', INTERVAL 1 DAY) s(x)), "
    "f AS (SELECT event_id, b, upto AS before FROM e ASOF JOIN d ON a >= r) SELECT event_id, (upto - before)::BIGINT AS nights FROM f ASOF JOIN d ON b >= r"
)
def rollover_nights(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted nights of all events' spans."""
    return _nights(T.table(spark, sf, "events"))


def _nights(e: DataFrame) -> DataFrame:
    stop = F.col("ts") + F.make_dt_interval(hours=F.col("event_id").cast("int") % 200)
    return e.select("event_id", execution.rollover_nights(F.col("ts"), stop).alias("nights"))


@register(f"WITH {SERIES_BARS} SELECT quantile_cont(spread, 0.01) AS spread_p01, quantile_cont(spread, 0.5) AS spread_p50, quantile_cont(spread, 0.99) AS spread_p99, quantile_cont(spread, 0.999) AS spread_p999, arg_max(time, (spread, time)) AS widest, avg((high = low)::INTEGER) AS flat, count(*) AS n FROM bars")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.spread_report(T.bars(spark, sf, "1 day", by_series=True))


@register(f"WITH {BARS}, r AS (SELECT time, ln(close / lag(close) {W}) AS r FROM bars), z AS (SELECT time, r, CASE WHEN count(r) OVER f = 50 THEN abs(r) / nullif(median(abs(r)) OVER f / 0.6745::DOUBLE, 0) END AS z FROM r WINDOW f AS (ORDER BY time ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) SELECT time, r, z FROM z WHERE z > 2 ORDER BY z DESC, time LIMIT 10")
def return_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.outliers(T.bars(spark, sf), 50, 2.0, 10)


def _rec(alpha: float, x: str, first: str = "x") -> str:
    return f"n AS (SELECT time, {x} AS x, row_number() OVER (ORDER BY time) AS i FROM src WHERE ({x}) IS NOT NULL), rec AS (SELECT i, time, {first}::DOUBLE AS y FROM n WHERE i = 1 UNION ALL SELECT n.i, n.time, rec.y * (1 - {alpha!r}::DOUBLE) + {alpha!r}::DOUBLE * n.x FROM rec JOIN n ON n.i = rec.i + 1)"


@register(f"WITH RECURSIVE {BARS}, src AS (SELECT time, close FROM bars), {_rec(2 / 21, 'close')} SELECT time, CASE WHEN i >= 20 THEN y END AS ema20 FROM rec")
def ema20(spark: SparkSession, sf: str) -> DataFrame:
    return ewm.with_kernels(T.bars(spark, sf).select("series_id", "time", "close"), {"ema20": lambda p: ewm.ema(p["close"], 20)}).select("time", "ema20")


@register(f"WITH RECURSIVE {BARS}, src AS (SELECT time, pow(ln(close / lag(close) {W}), 2) AS r2 FROM bars), {_rec(1 - 0.5 ** (1 / 50), 'r2')} SELECT time, CASE WHEN i >= 20 THEN sqrt(y) END AS vol FROM rec")
def ewma_vol(spark: SparkSession, sf: str) -> DataFrame:
    out = ewm.with_kernels(T.bars(spark, sf), {"vol": lambda p: ewm.ewma_vol(p, 50, 20)})
    first = F.row_number().over(series()) > 1
    return out.withColumn("k", first).filter("k").select("time", "vol")


@register(f"WITH RECURSIVE {BARS}, p AS (SELECT *, lag(close) {W} AS pc FROM bars), src AS (SELECT time, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p), {_rec(1 / 14, 'tr')} SELECT time, CASE WHEN i >= 14 THEN y END AS atr14 FROM rec")
def atr14(spark: SparkSession, sf: str) -> DataFrame:
    return ewm.with_kernels(T.bars(spark, sf), {"atr14": lambda p: ewm.atr(p, 14)}).select("time", "atr14")


@register(
    f"WITH RECURSIVE {BARS}, d AS (SELECT time, close - lag(close) {W} AS d FROM bars), n AS (SELECT time, d, row_number() OVER (ORDER BY time) AS i FROM d WHERE d IS NOT NULL), "
    f"rec AS (SELECT i, time, greatest(d, 0)::DOUBLE AS u, greatest(-d, 0)::DOUBLE AS v FROM n WHERE i = 1 UNION ALL SELECT n.i, n.time, rec.u * (1 - {1 / 14!r}::DOUBLE) + {1 / 14!r}::DOUBLE * greatest(d, 0), rec.v * (1 - {1 / 14!r}::DOUBLE) + {1 / 14!r}::DOUBLE * greatest(-d, 0) FROM rec JOIN n ON n.i = rec.i + 1) "
    "SELECT time, CASE WHEN i >= 14 THEN CASE WHEN u + v = 0 THEN 50 ELSE 100 * u / (u + v) END END AS rsi14 FROM rec"
)
def rsi14(spark: SparkSession, sf: str) -> DataFrame:
    out = ewm.with_kernels(T.bars(spark, sf), {"rsi14": lambda p: ewm.rsi(p, 14)})
    return out.withColumn("k", F.row_number().over(series())).filter("k > 1").select("time", "rsi14")



@register(f"WITH {BARS} SELECT isodow(time) - 1 AS weekday, hour(time) AS hour, count(*) AS n, avg(ln(close / open)) AS mean, var_samp(ln(close / open)) AS var FROM bars GROUP BY ALL")
def hour_of_week_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = F.ln(F.col("close") / F.col("open"))
    return T.bars(spark, sf).groupBy(F.weekday("time").cast("long").alias("weekday"), F.hour("time").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


@register(f"WITH {BARS} SELECT quantile_cont(close, 0.25) AS q25, quantile_cont(close, 0.5) AS q50, quantile_cont(close, 0.75) AS q75, stddev_pop(close) AS sd FROM bars")
def robust_scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    q = F.percentile("close", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return T.bars(spark, sf).agg(q.alias("q"), F.stddev_pop("close").alias("sd")).select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "sd")


_TRAIN = "time < TIMESTAMP '2024-01-15'"


@register(f"WITH {BARS}, z AS (SELECT time, ln(volume) AS x FROM bars), s AS (SELECT quantile_cont(x, 0.5) AS loc, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) * 0.7413::DOUBLE AS scale FROM z WHERE {_TRAIN}) SELECT time, greatest(least((x - loc) / scale, 5), -5) AS logvol FROM z, s")
def robust_scaler_apply(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.bars(spark, sf).select("series_id", "time", F.ln("volume").alias("logvol"))
    pipe = features.Pipeline([]).fit(raw.filter("time < TIMESTAMP_NTZ '2024-01-15'"))
    return pipe.transform(raw).select("time", "logvol")


@register("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1")
def props_json_agg(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return T.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


_EDGES = "SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM events WHERE ts < TIMESTAMP '2024-01-15'"


@register(
    f"WITH q AS ({_EDGES}), b AS (SELECT ts < TIMESTAMP '2024-01-15' AS old, len(list_filter(list_distinct(e), lambda x: x <= value)) AS bin FROM events, q), k AS (SELECT r.bin, greatest(count(*) FILTER (WHERE old)::DOUBLE / (SELECT count(*) FROM b WHERE old), 0.0001) AS e, greatest(count(*) FILTER (WHERE NOT old)::DOUBLE / (SELECT count(*) FROM b WHERE NOT old), 0.0001) AS a FROM b JOIN range(10) r(bin) USING (bin) GROUP BY 1), "
    "n AS (SELECT e / sum(e) OVER () AS e, a / sum(a) OVER () AS a FROM k) SELECT sum((a - e) * ln(a / e)) AS psi FROM n"
)
def psi_drift(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.table(spark, sf, "events")
    return risk.psi(ev.filter("ts < TIMESTAMP_NTZ '2024-01-15'"), ev.filter("ts >= TIMESTAMP_NTZ '2024-01-15'"), "value")


_FC = f"{BARS}, s AS (SELECT date_trunc('hour', time) AS time, arg_max(seq, (time, seq)) AS seq FROM ticks GROUP BY 1), f AS (SELECT time, (seq % 11 - 5) / 5.0::DOUBLE AS a, (seq % 7 - 3) / 2.0::DOUBLE AS b, CASE WHEN seq % 5 > 0 THEN (seq % 3 - 1)::DOUBLE END AS c, (date_diff('day', TIMESTAMP '2024-01-01', time) // 10)::INTEGER AS fold FROM s)"


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    s = T.ticks(spark, sf).groupBy(F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).agg(F.max_by("seq", F.struct("time", "seq")).alias("seq"))
    fold = F.floor(F.datediff("time", F.lit("2024-01-01").cast("date")) / 10).cast("int")
    return s.select("time", ((F.col("seq") % 11 - 5) / 5.0).alias("a"), ((F.col("seq") % 7 - 3) / 2.0).alias("b"), F.when(F.col("seq") % 5 > 0, (F.col("seq") % 3 - 1).cast("double")).alias("c"), fold.alias("fold"))


_CLIP = "greatest(least(coalesce({}, 0), 1), -1)"


@register(f"WITH {_FC} SELECT time, greatest(least(1.3::DOUBLE * (0.5::DOUBLE * {_CLIP.format('a')} + 0.3::DOUBLE * {_CLIP.format('b')} + 0.2::DOUBLE * {_CLIP.format('c')}), 1), -1) + 0.0::DOUBLE AS combined FROM f")
def combine_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.combine(_forecasts(spark, sf), {"a": 0.5, "b": 0.3, "c": 0.2}, 1.3).select("time", (F.col("combined") + 0.0).alias("combined"))


_WEIGHTS = [(f, s, round(0.2 + 0.1 * ((f + i) % 3), 1)) for f in range(3) for i, s in enumerate("abc")]
_WV = ",".join(f"({f},'{s}',{x}::DOUBLE)" for f, s, x in _WEIGHTS)


@register(f"WITH {_FC}, w(fold, strategy, weight) AS (VALUES {_WV}), l AS (SELECT time, fold, 'a' AS strategy, coalesce(a, 0) AS x FROM f UNION ALL SELECT time, fold, 'b', coalesce(b, 0) FROM f UNION ALL SELECT time, fold, 'c', coalesce(c, 0) FROM f) SELECT time, fold, strategy, 1.2::DOUBLE * weight * x AS contribution FROM l JOIN w USING (fold, strategy)")
def forecast_contributions(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame(_WEIGHTS, "fold int, strategy string, weight double")
    return rules.contributions(_forecasts(spark, sf), weights, ["a", "b", "c"], 1.2)


@register(f"WITH {MACRO} SELECT name, date, value, ln(value / lag(value, 5) OVER (PARTITION BY name ORDER BY date)) AS change5 FROM macro")
def macro_changes(spark: SparkSession, sf: str) -> DataFrame:
    return T.macro(spark, sf).select("name", "date", "value", F.ln(F.col("value") / F.lag("value", 5).over(Window.partitionBy("name").orderBy("date"))).alias("change5"))


@register(f"WITH {CALENDAR} SELECT time, arg_min(importance, seq) AS importance, min(seq) AS seq FROM calendar GROUP BY 1")
def calendar_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return T.calendar(spark, sf).groupBy("time").agg(F.min_by("importance", "seq").alias("importance"), F.min("seq").alias("seq"))


@register()
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """All twelve feature groups on all H1 bars."""
    pipe = features.Pipeline(list(features.GROUPS))
    return pipe.compute(T.bars(spark, sf), macro=T.macro(spark, sf), events=T.calendar(spark, sf))


@register()
def feature_matrix_scaled(spark: SparkSession, sf: str) -> DataFrame:
    pipe = features.Pipeline(["returns", "meanrev", "range", "session"])
    raw = pipe.compute(T.bars(spark, sf))
    return pipe.fit(raw.filter("time < TIMESTAMP_NTZ '2024-01-15'")).transform(raw)


@register()
def rule_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.bars(spark, sf)
    for f in rules.RULES.values():
        rows = f(rows)
    return rules.combine(rows, dict.fromkeys(rules.RULES, 1 / len(rules.RULES)), 1.5).select("series_id", "time", *rules.RULES, "combined")


@register()
def simulated_books(spark: SparkSession, sf: str) -> DataFrame:
    """A stateful book per user series of daily bars."""
    rows = ewm.with_kernels(rules.zscore_fade(T.bars(spark, sf, "1 day", by_series=True), 5, 1.0), {"vol": lambda p: ewm.ewma_vol(p, 10, 3) * 252**0.5})
    return execution.simulate(rows, "zscore_fade", COSTS, stop_mult=0.5).drop("deals", "swap")


@register()
def book_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return execution.trade_stats(simulated_books(spark, sf))


@register()
def bootstrap_means(spark: SparkSession, sf: str) -> DataFrame:
    return risk.bootstrap_means(_returns(spark, sf), 200, 10.0, seed=7)


@register()
def monte_carlo_paths(spark: SparkSession, sf: str) -> DataFrame:
    return risk.path_metrics(risk.simulate_paths(_returns(spark, sf), 500, 252, 10.0, seed=7))


@register()
def monte_carlo_fan(spark: SparkSession, sf: str) -> DataFrame:
    return risk.fan_bands(risk.simulate_paths(_returns(spark, sf), 500, 60, 10.0, seed=7), [0.05, 0.5, 0.95])


@register()
def cusum_events(spark: SparkSession, sf: str) -> DataFrame:
    return ewm.with_kernels(T.bars(spark, sf), {"event": lambda p: ewm.cusum_events(p, 2.0)}).filter("event != 0").select("time", "event")




@register()
def garch_by_series(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.plans import models

    rows = T.bars(spark, sf).withColumn("r", rolling.log_return(F.col("close")))
    return models.garch(rows)


@register()
def hmm_regimes(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.plans import models

    rows = T.bars(spark, sf).withColumn("r", rolling.log_return(F.col("close")))
    return models.regimes(rows, "2024-01-15")


@register(
    f"WITH {BARS}, r AS (SELECT pow(ln(close / lag(close) {W}), 2) AS r2, (available_at - INTERVAL 1 MICROSECOND)::DATE AS d FROM bars), k AS (SELECT CASE isodow(d) WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END::DATE AS date, r2 FROM r WHERE r2 IS NOT NULL) SELECT date, sum(r2) AS rv, count(*) AS n FROM k GROUP BY 1"
)
def daily_realised_variance(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.plans import models

    return models.daily_realised_variance(T.bars(spark, sf)).select("date", "rv", "n")


@register()
def har_forecast(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.plans import models

    daily = T.table(spark, sf, "orders").groupBy(F.lit(0).cast("long").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.var_samp("o_totalprice").alias("rv")).filter("rv IS NOT NULL")
    return models.har(daily, "1999-01-01")


@register()
def walk_forward_book(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.plans import research_runs as runs

    picked = {n: rules.RULES[n] for n in ("donchian", "zscore_fade", "bollinger_revert")}
    bars = T.bars(spark, sf)
    return runs.walk_forward(bars, picked, splits.walk_forward(bars.count(), 200, 100, purge=2, embargo=2), COSTS).select("time", "fold", "combined", "position", "pnl", "equity")


@register()
def sweep_zscore_fade(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.plans import research_runs as runs

    return runs.sweep(T.bars(spark, sf), rules.RULES["zscore_fade"], "zscore_fade", {"n": [10, 20, 40], "enter": [1.5, 2.0]}, COSTS)


@register()
def boosted_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Triple-barrier direction from features, by calibrated boosted trees fitted on the first half."""
    from chronosift.operators import labels
    from chronosift.plans import models

    rows = T.bars(spark, sf).withColumn("r", rolling.log_return(F.col("close"))).withColumn("t", rolling.std(F.col("r"), 20))
    y = labels.triple_barrier(rows, target="t", pt_mult=1.0, sl_mult=1.0, horizon=10).select("series_id", F.col("t_event").alias("time"), "t1_idx", (F.col("label") > 0).cast("double").alias("y"))
    # a label is known when its last bar is
    ends = rows.select("series_id", (F.row_number().over(rolling.series()) - 1).alias("t1_idx"), F.col("time").alias("label_end"))
    y = y.join(ends, ["series_id", "t1_idx"], "left").drop("t1_idx")
    x = features.GROUPS["meanrev"](T.bars(spark, sf)).select("series_id", "time", "meanrev_z_20", "meanrev_z_50", "meanrev_pct_b", F.col("meanrev_streak").cast("double").alias("meanrev_streak"))
    both = x.join(y, ["series_id", "time"])
    out = models.boosted_probability(both, ["meanrev_z_20", "meanrev_z_50", "meanrev_pct_b", "meanrev_streak"], "y", F.col("label_end") < F.lit("2024-01-15").cast("timestamp_ntz"), rounds=5)
    return out.select("time", "y", "p", models.bet_size(F.col("p")).alias("size"))


_ORD = "o AS (SELECT event_id, value / 10 - 25 AS wanted, (event_id % 9 - 4)::DOUBLE AS current, CASE WHEN event_id % 17 = 0 THEN 0.0::DOUBLE ELSE 100000.0 END AS equity, 100.0::DOUBLE AS price, (event_id % 30) / 20.0::DOUBLE AS spread, (event_id % 100) * 80.0::DOUBLE AS age, event_id % 23 AS trades_today, event_id % 11 = 0 AS blackout, event_id % 97 = 0 AS halted FROM events)"
_NNR = "CASE WHEN current > 0 THEN least(greatest(capped, 0), current) WHEN current < 0 THEN greatest(least(capped, 0), current) ELSE 0.0 END"
_TZ = "CASE WHEN wanted > 0 THEN least(greatest(capped, 0), wanted) WHEN wanted < 0 THEN greatest(least(capped, 0), wanted) ELSE 0.0 END"


@register(
    f"WITH {_ORD}, c AS (SELECT *, greatest(least(wanted, least(3.0::DOUBLE * equity / (price * 100), 50)), -least(3.0::DOUBLE * equity / (price * 100), 50)) AS capped FROM o), "
    "r AS (SELECT *, CASE WHEN halted THEN 'halted' WHEN NOT (equity > 0 AND price > 0) THEN 'invalid' WHEN blackout THEN 'blackout' WHEN spread > 1 THEN 'spread' WHEN age > 7200 THEN 'stale' WHEN trades_today >= 20 THEN 'trades' WHEN capped <> wanted THEN 'exposure' ELSE 'ok' END AS reason FROM c) "
    f"SELECT event_id, reason, CASE WHEN reason = 'halted' THEN 0.0 WHEN reason = 'invalid' THEN current WHEN reason IN ('blackout', 'spread', 'stale', 'trades') THEN {_NNR} ELSE {_TZ} END + 0.0::DOUBLE AS approved FROM r"
)
def risk_approval(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.operators import desk

    e = F.col("event_id")
    orders = T.table(spark, sf, "events").select(
        "event_id", (F.col("value") / 10 - 25).alias("wanted"), (e % 9 - 4).cast("double").alias("current"), F.when(e % 17 == 0, 0.0).otherwise(100_000.0).alias("equity"), F.lit(100.0).alias("price"),
        ((e % 30) / 20.0).alias("spread"), ((e % 100) * 80.0).alias("age"), (e % 23).alias("trades_today"), (e % 11 == 0).alias("blackout"), (e % 97 == 0).alias("halted"),
    )
    return desk.approve(orders, costs=execution.Costs()).select("event_id", "reason", (F.col("approved") + 0.0).alias("approved"))


@register("SELECT user_id AS cycle_id, arg_max(CASE WHEN event_type = 'purchase' THEN props END, CASE WHEN event_type = 'purchase' THEN event_id END) AS decision, arg_max(CASE WHEN event_type = 'signup' THEN props END, CASE WHEN event_type = 'signup' THEN event_id END) AS policy, count(*) FILTER (WHERE event_type = 'click') AS tool_calls, 0::BIGINT AS tool_errors, sum(event_id)::BIGINT AS tokens FROM events GROUP BY 1")
def journal_summary(spark: SparkSession, sf: str) -> DataFrame:
    from chronosift.operators import desk

    kind = F.col("event_type")
    name = F.when(kind == "purchase", "decision").when(kind == "signup", "policy").when(kind == "click", "tool_call").otherwise(kind)
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("cycle_id"), F.col("event_id").alias("seq"), name.alias("event"), F.col("props").alias("status"), F.col("event_id").alias("tokens"))
    return desk.journal_summary(rows)


@register()
def opening_range_breakout(spark: SparkSession, sf: str) -> DataFrame:
    return rules.orb(T.bars(spark, sf)).select("time", "orb")


@register()
def seasonality_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.bars(spark, sf)
    fitted = rules.fit_seasonality(rows.filter("time < TIMESTAMP_NTZ '2024-01-22'"))
    return rules.seasonality(rows, fitted).select("time", (F.col("intraday_seasonality") + 0.0).alias("intraday_seasonality"))


@register()
def macro_forecast(spark: SparkSession, sf: str) -> DataFrame:
    signs = {"1-URGENT": -1.0, "2-HIGH": 1.0}
    return rules.macro_factor(T.bars(spark, sf), T.macro(spark, sf), signs).select("time", (F.col("macro_factor") + 0.0).alias("macro_factor"))


@register()
def managed_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return rules.managed(T.bars(spark, sf)).select("time", "managed")
