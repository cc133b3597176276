"""Registered queries on spacing, dates, further averages, rolling ratios, folds, fills and monitors; and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.functions import ewm
from chronosift.functions import timeframes as tf
from chronosift.operators import books, compare, rolling
from chronosift.plans.market import BARS, MACRO, RETURNS, SERIES_BARS, W
from chronosift.plans.research import _returns
from chronosift.sources import macro as macros
from chronosift.sources import tables as T
from chronosift.streaming import monitors

_Q: dict = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_GAPS = f"ga AS (SELECT series_id, (epoch_us(time) - epoch_us(lag(time) {W})) / 60000000 AS minutes FROM bars), gb AS (SELECT series_id, minutes, count(*) AS n FROM ga WHERE minutes > 0 GROUP BY ALL)"


@register(
    f"WITH {SERIES_BARS}, {_GAPS}, gc AS (SELECT series_id, arg_max(minutes, (n, -minutes)) AS m, max(n) AS top, sum(n) AS al FROM gb GROUP BY 1), gd AS (SELECT series_id, quantile_cont(minutes, 0.5) AS median FROM ga WHERE minutes > 0 GROUP BY 1) SELECT series_id, CASE WHEN top >= 2 AND 2 * top >= al THEN m END::DOUBLE AS minutes, median::DOUBLE AS median FROM gc JOIN gd USING (series_id)"
)
def bar_durations(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest and the median spacing of each series."""
    return tf.duration(T.bars(spark, sf, "1 day", by_series=True))


@register(
    f"WITH {BARS} SELECT time, CASE isodow(time::DATE) WHEN 6 THEN time::DATE + 2 WHEN 7 THEN time::DATE + 1 ELSE time::DATE END::DATE AS trading, (time + INTERVAL 3 HOUR)::DATE AS session, (time + INTERVAL 30 MINUTE)::DATE AS middle FROM bars"
)
def bar_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Trading date, date of a session anchored at 21 h, and the middle's date."""
    t = F.col("time")
    return T.bars(spark, sf).select("time", books.trading_date(t).alias("trading"), books.session_date(t, 21).alias("session"), tf.middle_date(t, F.col("available_at")).alias("middle"))


def _adjusted(alpha: float, least: int, post: str) -> str:
    return (
        f"WITH RECURSIVE {BARS}, r AS (SELECT time, ln(close / lag(close) {W}) AS r FROM bars), n AS (SELECT time, r, r * r AS r2, row_number() OVER (ORDER BY time) AS i FROM r WHERE r IS NOT NULL), rec AS (SELECT i, time, r::DOUBLE AS a, r2::DOUBLE AS b, 1.0::DOUBLE AS s FROM n WHERE i = 1 UNION ALL SELECT n.i, n.time, rec.a * {1 - alpha!r}::DOUBLE + n.r, rec.b * {1 - alpha!r}::DOUBLE + n.r2, rec.s * {1 - alpha!r}::DOUBLE + 1 FROM rec JOIN n ON n.i = rec.i + 1) {post}"
    )


@register(_adjusted(1 - 0.5 ** (1 / 20), 10, "SELECT time, CASE WHEN i >= 10 THEN a / s END AS mean, CASE WHEN i >= 10 THEN sqrt(b / s) END AS vol FROM rec"))
def ewm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and volatility of returns with normalised weights."""
    rows = T.bars(spark, sf).withColumn("r", rolling.log_return(F.col("close")))
    out = ewm.with_kernels(rows, {"mean": lambda p: ewm.ewma_mean(p["r"].astype(float), 20, 10), "vol": lambda p: ewm.bar_volatility(p, 20, 10)})
    return out.filter("r IS NOT NULL").select("time", "mean", "vol")


@register(
    f"WITH RECURSIVE {BARS}, n AS (SELECT time, pow(ln(close / lag(close) {W}), 2) AS x, row_number() OVER (ORDER BY time) - 1 AS i FROM bars), rec AS (SELECT i, time, x::DOUBLE AS y FROM n WHERE i = 1 UNION ALL SELECT n.i, n.time, rec.y * {0.5 ** (1 / 50)!r}::DOUBLE + {1 - 0.5 ** (1 / 50)!r}::DOUBLE * n.x FROM rec JOIN n ON n.i = rec.i + 1) "
    "SELECT n.time, CASE WHEN rec.i >= 20 THEN greatest(least(sqrt(y) * sqrt(24.0::DOUBLE), 3), 0.5) ELSE 0.2 END::DOUBLE AS vol FROM n LEFT JOIN rec USING (i)"
)
def annual_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility within bounds, and a stated value where there is none yet."""
    return ewm.with_kernels(T.bars(spark, sf), {"vol": lambda p: ewm.annual_volatility(p, 50, 24.0, 20, 0.5, 3.0, 0.2)}).select("time", "vol")


@register(f"WITH {RETURNS}, r AS (SELECT date, ret FROM returns WHERE ret IS NOT NULL) SELECT date, CASE WHEN count(*) OVER f = 63 THEN avg(ret) OVER f / nullif(stddev_samp(ret) OVER f, 0) * sqrt(252.0::DOUBLE) END AS sharpe FROM r WINDOW f AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)")
def rolling_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """The ratio of the last 63 days, a year."""
    w = Window.orderBy("date").rowsBetween(-62, 0)
    rows = _returns(spark, sf)
    return rows.select("date", F.when(F.count("ret").over(w) == 63, F.try_divide(F.avg("ret").over(w), F.stddev_samp("ret").over(w)) * math.sqrt(252)).alias("sharpe"))


_WM = "OVER (PARTITION BY name ORDER BY date)"


@register(
    f"WITH {MACRO}, a AS (SELECT *, ln(value) AS x, ln(value / lag(value) {_WM}) AS d FROM macro), b AS (SELECT *, CASE WHEN count(d) OVER f = 60 THEN stddev_samp(d) OVER f END AS s FROM a WINDOW f AS (PARTITION BY name ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) "
    f"SELECT name, date, ((x - lag(x, 10) {_WM}) / nullif(s * sqrt(10.0::DOUBLE), 0) + (x - lag(x, 40) {_WM}) / nullif(s * sqrt(40.0::DOUBLE), 0)) / 2 AS z, max(available_at) {_WM} AS known_at FROM b"
)
def macro_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each series over two horizons in units of its volatility, and when all of that was known."""
    by = Window.partitionBy("name").orderBy("date")
    rows = T.macro(spark, sf).withColumns({"x": F.ln("value"), "d": F.ln(F.col("value") / F.lag("value").over(by))})
    frame = by.rowsBetween(-59, 0)
    rows = rows.withColumn("s", F.when(F.count("d").over(frame) == 60, F.stddev_samp("d").over(frame)))
    z = sum((F.try_divide(F.col("x") - F.lag("x", h).over(by), F.col("s") * math.sqrt(h)) for h in (10, 40)), F.lit(0.0)) / 2
    return rows.select("name", "date", z.alias("z"), tf.latest_so_far([F.col("available_at")], F.col("date"), ["name"]).alias("known_at"))


@register(
    "WITH f AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, 20 + value / 10 AS mid, 0.1::DOUBLE + (event_id % 7) / 100.0::DOUBLE AS spread FROM events), g AS (SELECT *, side * 0.01::DOUBLE * (event_id % 30) AS short, spread / 2 + 0.02::DOUBLE AS expected, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM f), h AS (SELECT * FROM g WHERE k <= 50) "
    "SELECT count(*) AS fills, avg(side * short) AS realised, avg(expected) AS expected, avg(side * short) / avg(expected) AS ratio, sum((side * short - expected) * 100) AS excess, count(*) >= 10 AND avg(side * short) > 2 * avg(expected) + 0.05 AS alert FROM h"
)
def slippage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Shortfall of the newest fifty fills against what was expected, and whether that is an alert."""
    e = T.table(spark, sf, "events")
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    fills = e.select(F.col("ts").alias("time"), F.col("event_id").alias("seq"), side.alias("side"), (20 + F.col("value") / 10).alias("mid"), (0.1 + (F.col("event_id") % 7) / 100.0).alias("spread"))
    fills = fills.withColumns({"price": F.col("mid") + F.col("side") * 0.01 * (F.col("seq") % 30), "lots": F.lit(1.0)})
    return monitors.slippage(monitors.shortfall(fills, extra=0.02), last=50)


@register("WITH a AS (SELECT ts, event_type AS kind, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events), b AS (SELECT *, CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 7200000000 THEN 1 ELSE 0 END AS n FROM a) SELECT kind, sum(n)::BIGINT AS sent, count(*) AS raised FROM b GROUP BY 1")
def alert_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of a kind are one burst until two quiet hours have passed."""
    return monitors.bursts(T.table(spark, sf, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("kind")), "2 hours")


@register(
    "WITH s AS (SELECT ts, user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), m AS (SELECT *, CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS nw FROM s), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id AS series_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM g GROUP BY user_id, k"
)
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user that six quiet hours end; the same call works on a stream."""
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("time"), F.col("value").alias("price"))
    return monitors.sessions(rows, "6 hours").select("series_id", "start", "stop", "n")


@register(
    "WITH h AS (SELECT user_id, ts, value FROM events), k AS (SELECT user_id, ts, value, unnest([0, 1, 2, 3]) AS j FROM h), w AS (SELECT user_id, date_trunc('hour', ts) - to_hours(j::BIGINT) AS start, value FROM k) SELECT user_id AS series_id, start, start + INTERVAL 4 HOUR AS stop, avg(value + 1) AS mean, count(*) AS n FROM w GROUP BY ALL"
)
def sliding_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means over four hours, every hour; the same call works on a stream."""
    rows = T.ticks(spark, sf)
    return monitors.sliding(rows, "4 hours", "1 hour").select("series_id", "start", "stop", "mean", "n")


_PB = "q AS (SELECT event_id, (event_id % 21 - 10) / 10.0::DOUBLE AS quant, CASE WHEN event_id % 9 > 0 THEN (event_id % 31 - 15) / 10.0::DOUBLE END AS desk FROM events)"


@register(
    f"WITH {_PB} SELECT event_id, CASE WHEN desk IS NULL THEN quant WHEN quant = 0 THEN 0 WHEN quant > 0 THEN least(greatest(desk, 0), quant) ELSE greatest(least(desk, 0), quant) END::DOUBLE AS overlay, CASE WHEN desk IS NULL THEN quant ELSE greatest(least(greatest(least(desk, 1), -1), quant + 0.3::DOUBLE), quant - 0.3::DOUBLE) END::DOUBLE AS bounded FROM q"
)
def desk_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """A desk's forecast never flips or enlarges the rules' one (overlay), or stays near it."""
    e = F.col("event_id")
    rows = T.table(spark, sf, "events").select("event_id", ((e % 21 - 10) / 10.0).alias("quant"), F.when(e % 9 > 0, (e % 31 - 15) / 10.0).alias("desk"))
    return rows.select("event_id", (monitors.overlay(F.col("quant"), F.col("desk")) + 0.0).alias("overlay"), monitors.bounded(F.col("quant"), F.col("desk"), 0.3).alias("bounded"))


@register(f"WITH {MACRO} SELECT name, count(*) AS n, max(date) AS newest FROM macro WHERE available_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def macro_known(spark: SparkSession, sf: str) -> DataFrame:
    """What was published by a cut."""
    return macros.published(T.macro(spark, sf), "2024-01-20 12:00:00").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("newest"))


@register(f"WITH {BARS}, a AS (SELECT time, close, close * 1.0000001::DOUBLE AS x, CASE WHEN hour(time) = 3 THEN NULL ELSE close + CASE WHEN hour(time) = 5 THEN 1 ELSE 0 END END AS y FROM bars) SELECT 'close' AS column, count(*) AS rows, max(abs(close - y)) AS largest, count(*) FILTER (WHERE abs(close - y) > 1e-9) AS mismatches, count(*) FILTER (WHERE y IS NULL) AS null_mismatches FROM a")
def parity_of_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Column by column, how two frames differ."""
    a = T.bars(spark, sf).select("series_id", "time", "close")
    b = a.withColumn("close", F.when(F.hour("time") != 3, F.col("close") + F.when(F.hour("time") == 5, 1).otherwise(0)))
    return compare.parity_report(a, b, ["close"], ["series_id", "time"], 1e-9)


@register(f"WITH {BARS}, n AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER () AS n FROM bars) SELECT time, close FROM n WHERE i % ceil(n / 100)::BIGINT = 0 OR i = n - 1")
def thinned(spark: SparkSession, sf: str) -> DataFrame:
    """About a hundred bars for a chart, the last among them."""
    return tf.thin(T.bars(spark, sf), 100).select("time", "close")


@register(f"WITH {SERIES_BARS} SELECT series_id, max(time) AS time, arg_max(close, time) AS close FROM bars WHERE time <= TIMESTAMP '2024-01-15' GROUP BY 1")
def newest_by(spark: SparkSession, sf: str) -> DataFrame:
    """Each series' last bar at a time."""
    return tf.at_or_before(T.bars(spark, sf, "1 day", by_series=True), "2024-01-15").select("series_id", "time", "close")
