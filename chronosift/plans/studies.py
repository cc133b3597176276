"""Registered queries on drift references, account bands, resampled statistics and metrics of one's own; and their SQL."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from chronosift.functions.scalars import normal_quantile
from chronosift.operators import cycles, references, reports, resamples, snapshots, splits
from chronosift.operators.resample import ticks_to_bars
from chronosift.plans import combination, crossframes, evidence, feature_queries, features, learning_queries, regimes, sweeps, warmup
from chronosift.plans.evidence import phi
from chronosift.plans.market import BAR_COLS, BARS, CALENDAR, MACRO, W, g, w
from chronosift.plans.research import COSTS, PERF, _perf
from chronosift.sources import tables as T
from chronosift.streaming import retries

_Q: dict = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# ---- drift -------------------------------------------------------------------
#: The reference is what was shipped before this day; later lines are held against it by month.
SINCE, COLUMNS = "1998-01-01", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "days"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "lineitem")
    return rows.withColumns({"days": F.pmod(F.datediff("l_shipdate", F.lit("1990-01-01")) * F.col("l_linenumber"), F.lit(997)).cast("double"), "month": F.date_trunc("month", "l_shipdate").cast("date")})


def _reference(spark: SparkSession, sf: str) -> references.Reference:
    return references.reference(_lines(spark, sf).filter(F.col("l_shipdate") < F.lit(SINCE).cast("timestamp_ntz")), COLUMNS)


_LONG = "long AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, l_shipdate < TIMESTAMP '1998-01-01' AS old, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber', 'days']) AS col, unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, ((l_shipdate::DATE - DATE '1990-01-01') * l_linenumber) % 997]::DOUBLE[]) AS value FROM lineitem)"
_EDGES = (
    "vals AS (SELECT col, list_sort(list(DISTINCT value)) AS vs FROM long WHERE old GROUP BY col), "
    "qs AS (SELECT col, list_sort(list_distinct(quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS q FROM long WHERE old GROUP BY col), "
    "ed AS (SELECT col, CASE WHEN len(vs) <= 10 THEN list_transform(range(1, len(vs)), lambda i: (vs[i] + vs[i + 1]) / 2) ELSE q END AS edges FROM vals JOIN qs USING (col)), "
    "binned AS (SELECT col, month, old, len(list_filter(edges, lambda e: e <= value)) AS bin FROM long JOIN ed USING (col)), "
    "ex AS (SELECT col, bin, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY col) AS expected FROM (SELECT col, unnest(range(len(edges) + 1)) AS bin FROM ed) LEFT JOIN (SELECT col, bin, count(*) AS n FROM binned WHERE old GROUP BY ALL) USING (col, bin))"
)


@register(f"WITH {_LONG}, {_EDGES} SELECT col AS \"column\", bin::INTEGER AS bin, CASE WHEN bin > 0 THEN edges[bin] END AS from_, expected FROM ex JOIN ed USING (col)")
def drift_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of all columns of the old lines, with the shares expected in each."""
    known = _reference(spark, sf).frame(spark)
    return known.select("column", F.posexplode("expected").alias("bin", "expected"), "edges").select("column", "bin", F.when(F.col("bin") > 0, F.get("edges", F.col("bin") - 1)).alias("from_"), "expected")


_PSI = (
    f"{_LONG}, {_EDGES}, ac AS (SELECT col, month, bin, count(*) AS n FROM binned WHERE NOT old GROUP BY ALL), gr AS (SELECT col, month, sum(n) AS total FROM ac GROUP BY ALL), "
    "fl AS (SELECT gr.col, gr.month, total, ex.bin, greatest(expected, 1e-4) AS e, greatest(coalesce(n, 0) / total, 1e-4) AS a FROM gr JOIN ex ON ex.col = gr.col LEFT JOIN ac ON ac.col = gr.col AND ac.month = gr.month AND ac.bin = ex.bin), "
    "nr AS (SELECT col, month, total, e / sum(e) OVER w AS e, a / sum(a) OVER w AS a FROM fl WINDOW w AS (PARTITION BY col, month)), "
    "psi AS (SELECT month, col AS \"column\", total::BIGINT AS n, CASE WHEN total >= 100 THEN sum((a - e) * ln(a / e)) END AS psi FROM nr GROUP BY month, col, total), "
    "lv AS (SELECT *, CASE WHEN psi IS NULL THEN 'few' WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END AS level FROM psi)"
)


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    later = _lines(spark, sf).filter(F.col("l_shipdate") >= F.lit(SINCE).cast("timestamp_ntz"))
    return references.drift(_reference(spark, sf), later, ["month"])


@register(f"WITH {_PSI} SELECT month, \"column\", n, psi, level FROM lv")
def drift_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The stability index of every column in every later month, from one unpivoted pass."""
    return _drift(spark, sf)


@register(f"WITH {_PSI} SELECT month, \"column\", psi, row_number() OVER (PARTITION BY month ORDER BY psi DESC, \"column\")::INTEGER AS place FROM lv WHERE psi IS NOT NULL QUALIFY place <= 3")
def drift_top(spark: SparkSession, sf: str) -> DataFrame:
    return references.top(_drift(spark, sf), 3, ["month"]).select("month", "column", "psi", "place")


@register(f"WITH {_PSI} SELECT month, count(psi) AS columns, max(psi) AS max_psi, count(*) FILTER (WHERE level = 'warn') AS n_warn, count(*) FILTER (WHERE level = 'alert') AS n_alert, coalesce(string_agg(\"column\", ',' ORDER BY \"column\") FILTER (WHERE level = 'alert'), '') AS alerts FROM lv GROUP BY month")
def drift_reports(spark: SparkSession, sf: str) -> DataFrame:
    return references.drift_report(_drift(spark, sf), ["month"])


_BAND = references.band_of({"combined": {"sharpe": 0.8, "ann_vol": 0.12}})


@register(
    "WITH q AS (SELECT user_id, ts, 10000 + sum(value - 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS equity FROM events), p AS (SELECT * FROM q WHERE equity > 0), "
    "d AS (SELECT user_id, CASE WHEN isodow(ts) >= 6 THEN ts::DATE + (8 - isodow(ts))::INTEGER ELSE ts::DATE END AS day, arg_max(equity, ts) AS close, arg_min(equity, ts) AS open FROM p GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER w - 1 AS n_days, first_value(open) OVER w AS first FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)), "
    f"z AS (SELECT user_id, day, n_days, ln(close / first) AS cum, n_days * {_BAND[0]!r}::DOUBLE AS expected, {_BAND[1]!r}::DOUBLE * sqrt(n_days) AS spread FROM r) "
    "SELECT user_id, day, n_days, cum, expected, (cum - expected) / nullif(spread, 0) AS z, CASE WHEN n_days > 0 THEN expected - 3 * spread END AS low, CASE WHEN n_days > 0 THEN expected + 3 * spread END AS high, "
    "CASE WHEN n_days < 5 THEN 'ok' WHEN (cum - expected) / spread <= -3 THEN 'critical' WHEN (cum - expected) / spread <= -2 THEN 'warning' ELSE 'ok' END AS level FROM z"
)
def account_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's account after each of its days, against the band of a yearly ratio and volatility."""
    rows = T.table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    equity = rows.select("user_id", F.col("ts").alias("time"), (10_000 + F.sum(F.col("value") - 60).over(w)).alias("equity"))
    return references.account_band(equity, ["user_id"], _BAND)


# ---- resampled statistics ----------------------------------------------------
SAMPLES, BLOCK = 40, 8.0
STATISTICS = {"median": lambda x: F.median(x), "sharpe": lambda x: F.try_divide(F.avg(x), F.stddev_samp(x)), "tail": lambda x: F.percentile(x, F.lit(0.1))}


def downside(x) -> float:
    """Mean over the root mean square of what lies below 0."""
    below = (x.clip(upper=0.0) ** 2).mean()
    return x.mean() / below**0.5 if below > 0 else float("nan")


_HASH = "('0x' || substr(md5('{}|' || s || '|' || i), 1, 13))::BIGINT / 4503599627370496::DOUBLE"
_ALL = "median(ret) AS median, avg(ret) / stddev_samp(ret) AS sharpe, quantile_cont(ret, 0.1) AS tail, avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) AS downside"
_BOOT = (
    f"{PERF}, pp AS (SELECT name, ret, row_number() OVER (PARTITION BY name ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM perf WHERE ret IS NOT NULL), "
    f"dr AS (SELECT name, i, n, s, i = 0 OR {_HASH.format('0r')} < {1 / BLOCK} AS fresh, floor({_HASH.format('0s')} * n)::BIGINT AS start FROM pp, range({SAMPLES}) r(s)), "
    "bg AS (SELECT name, i, n, s, last_value(CASE WHEN fresh THEN start - i END IGNORE NULLS) OVER (PARTITION BY name, s ORDER BY i) AS move FROM dr), "
    "rs AS (SELECT bg.name, bg.s, bg.i, pp.ret FROM bg JOIN pp ON pp.name = bg.name AND pp.i = (bg.i + bg.move + bg.n) % bg.n), "
    f"st AS (UNPIVOT (SELECT name, s, {_ALL} FROM rs GROUP BY ALL) ON median, sharpe, tail, downside INTO NAME statistic VALUE v), "
    f"es AS (UNPIVOT (SELECT name, count(*) AS n, {_ALL} FROM pp GROUP BY name) ON median, sharpe, tail, downside INTO NAME statistic VALUE estimate), "
    "ov AS (SELECT name, statistic, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper, stddev_samp(v) AS std_error, avg(v) AS m, avg((v <= 0)::INTEGER) AS prob_le_zero FROM st GROUP BY ALL)"
)


@register(f"WITH {_BOOT} SELECT name, statistic, n, estimate, lower, upper, std_error, m - estimate AS bias, prob_le_zero FROM es JOIN ov USING (name, statistic)")
def bootstrap_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of three expressions and of a user's function, for every series."""
    return resamples.bootstrap(_perf(spark, sf), ["name"], STATISTICS, {"downside": downside}, value="ret", order="date", samples=SAMPLES, block=BLOCK)


@register(f"WITH {_BOOT} SELECT name, s::INTEGER AS sample, i::INTEGER AS i, ret AS x FROM rs")
def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    """The resampled rows themselves."""
    return resamples.resampled(_perf(spark, sf), ["name"], value="ret", order="date", samples=SAMPLES, block=BLOCK)


_SIDES = ",".join(f"({i},{b},{str(b in c).lower()})" for i, c in enumerate(itertools.combinations(range(6), 3)) for b in range(6))
_CSCV = (
    f"{PERF}, d AS (SELECT date, ntile(6) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM perf WHERE ret IS NOT NULL)), c(combo, block, side) AS (VALUES {_SIDES}), "
    "m AS (SELECT combo, name, median(ret) FILTER (WHERE side) AS inside, median(ret) FILTER (WHERE NOT side) AS outside FROM perf JOIN d USING (date) JOIN c USING (block) WHERE ret IS NOT NULL GROUP BY ALL), "
    "r AS (SELECT *, (rank() OVER (PARTITION BY combo ORDER BY outside) - 1 + (count(*) OVER (PARTITION BY combo, outside) + 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY combo) + 1) AS w, row_number() OVER (PARTITION BY combo ORDER BY inside DESC, name) AS best FROM m)"
)


@register(f"WITH {_CSCV} SELECT combo, name AS chosen, inside, outside, w, ln(w / (1 - w)) AS logit FROM r WHERE best = 1")
def cscv_median(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated choice by a metric that sums of blocks can't give."""
    return resamples.cscv(_perf(spark, sf), F.median, blocks=6)


# ---- sweeps ------------------------------------------------------------------
AXES = {"fast": [4, 8], "slow": [20, 40]}
_POINTS = [(f, s) for f in AXES["fast"] for s in AXES["slow"]]


def crossover_point(rows: DataFrame, base: WindowSpec) -> DataFrame:
    """The gap of two means, fast and slow in columns, in deviations of the slow one, within 1."""
    full = lambda n: base.rowsBetween(-(n - 1), 0)
    picked = lambda axis, f: F.coalesce(*[F.when(F.col(axis) == n, f(full(n))) for n in AXES[axis]])
    mean = lambda n: F.avg("close").over(n)
    spread = picked("slow", lambda n: F.stddev_samp("close").over(n))
    whole = picked("slow", lambda n: F.count("close").over(n)) == F.col("slow")
    z = F.when(whole, F.try_divide(picked("fast", mean) - picked("slow", mean), spread))
    return rows.withColumn("position", F.coalesce(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0)), F.lit(0.0)))


def _oos(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_queries.pooled_bars(spark, sf)
    return sweeps.walk_forward_points(rows.select("series_id", "time", "open", "high", "low", "close", "spread"), crossover_point, AXES, learning_queries.folds_of(rows), COSTS)


def _sweep_sql() -> str:
    frame = lambda n: f"OVER (PARTITION BY series_id ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    each = " UNION ALL ".join(
        f"SELECT {f}::INTEGER AS fast, {s}::INTEGER AS slow, 'fast={f},slow={s}' AS label, series_id, time, pos, open, high, low, close, spread, coalesce(greatest(least(CASE WHEN count(close) {frame(s)} = {s} THEN (avg(close) {frame(f)} - avg(close) {frame(s)}) / nullif(stddev_samp(close) {frame(s)}, 0) END, 1), -1), 0) AS raw FROM feats"
        for f, s in _POINTS
    )
    by = "OVER (PARTITION BY label, series_id ORDER BY time)"
    return (
        f"{learning_queries._FEATURED}, pt AS MATERIALIZED ({each}), mn AS (SELECT label, series_id, fold, avg(abs(raw)) AS mean FROM pt JOIN folds ON pos >= a AND pos < b GROUP BY ALL), "
        "ho AS (SELECT pt.*, folds.fold, CASE WHEN mean > 0 THEN least(0.5 / mean, 4.0) ELSE 0.0 END AS scalar FROM pt JOIN folds ON pos >= c AND pos < d JOIN mn ON mn.label = pt.label AND mn.series_id = pt.series_id AND mn.fold = folds.fold), "
        "ta AS (SELECT *, greatest(least(scalar * raw, 1.0), -1.0) AS target FROM ho), "
        f"pa AS (SELECT *, coalesce(lag(target) {by}, 0) AS position, coalesce(lag(target, 2) {by}, 0) AS prior, coalesce(lag(close) {by}, open) AS pc FROM ta), "
        "oos AS MATERIALIZED (SELECT *, 100 * (prior * (open - pc) + position * (close - open)) - CASE WHEN abs(position - prior) > 0 THEN abs(position - prior) * 100 * (spread / 2 + 0.02::DOUBLE + 0.05::DOUBLE * (high - low)) + abs(position - prior) * 3.5::DOUBLE ELSE 0.0 END AS pnl FROM pa)"
    )


_OOS = _sweep_sql()
_HOURS = (
    f"{_OOS}, dp AS (SELECT label, date_trunc('hour', time) AS date, sum(pnl) AS pnl FROM oos GROUP BY ALL), rt AS (SELECT label, date, pnl / nullif(10000000 + coalesce(sum(pnl) OVER (PARTITION BY label ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS ret FROM dp), "
    "wh AS (SELECT * FROM rt WHERE ret IS NOT NULL AND date IN (SELECT date FROM rt WHERE ret IS NOT NULL GROUP BY date HAVING count(DISTINCT label) = (SELECT count(DISTINCT label) FROM rt WHERE ret IS NOT NULL)))"
)
_HALVES = ",".join(f"({i},{b},{str(b in c).lower()})" for i, c in enumerate(itertools.combinations(range(8), 4)) for b in range(8))
_PBO = (
    f"{_HOURS}, dd AS (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM wh)), cc(combo, block, side) AS (VALUES {_HALVES}), "
    "mm AS (SELECT combo, label, avg(ret) FILTER (WHERE side) / nullif(stddev_samp(ret) FILTER (WHERE side), 0) AS inside, avg(ret) FILTER (WHERE NOT side) / nullif(stddev_samp(ret) FILTER (WHERE NOT side), 0) AS outside FROM wh JOIN dd USING (date) JOIN cc USING (block) GROUP BY ALL), "
    "rr AS (SELECT *, (rank() OVER (PARTITION BY combo ORDER BY outside NULLS FIRST) - 1 + (count(*) OVER (PARTITION BY combo, outside) + 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY combo) + 1) AS w, row_number() OVER (PARTITION BY combo ORDER BY inside DESC NULLS LAST, label) AS best FROM mm), "
    "pb AS (SELECT combo, label AS chosen, inside, outside, w, ln(w / (1 - w)) AS logit FROM rr WHERE best = 1)"
)


@register(
    f"WITH {_OOS}, st AS (SELECT fast, slow, label, count(DISTINCT fold) AS n_folds, count(pnl) AS bars, avg(pnl) / stddev_samp(pnl) AS sr, sum(pow(pnl - m, 3)) / count(*) / pow(stddev_pop(pnl), 3) AS skew, sum(pow(pnl - m, 4)) / count(*) / pow(stddev_pop(pnl), 4) AS kurt FROM (SELECT *, avg(pnl) OVER (PARTITION BY label) AS m FROM oos) GROUP BY ALL), "
    "k AS (SELECT *, dense_rank() OVER (ORDER BY fast) AS i, dense_rank() OVER (ORDER BY slow) AS j FROM st) SELECT a.fast, a.slow, a.label, a.n_folds, a.bars, a.sr, a.skew, a.kurt, (SELECT avg(b.sr) FROM k b WHERE abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND NOT (a.i = b.i AND a.j = b.j)) AS plateau FROM k a"
)
def sweep_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Every point of a crossover's grid through all folds of all pools."""
    return sweeps.sweep_table(_oos(spark, sf), AXES)


@register(f"WITH {_OOS} SELECT label, series_id, fold, time, scalar::DOUBLE AS scalar, position::DOUBLE AS position, pnl FROM oos")
def sweep_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The out-of-sample bars of every point."""
    return _oos(spark, sf).select("label", "series_id", "fold", "time", "scalar", "position", "pnl")


@register(f"WITH {_PBO} SELECT combo, chosen, inside, outside, w, logit FROM pb")
def sweep_pbo(spark: SparkSession, sf: str) -> DataFrame:
    """What cross-validation of the sweep's hourly returns chooses, and how that does outside."""
    return sweeps.grid_pbo(sweeps.period_returns(_oos(spark, sf), 1e7, "hour"))


_ENTRIES = "e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS symbol, o_orderdate AS a, o_orderdate + to_days((o_orderkey % 60)::INTEGER) AS b, ['c' || (o_orderkey % 7), 'c' || (o_custkey % 13)] AS hashes FROM orders WHERE o_orderkey % 17 <> 0)"


@register(
    f"WITH {_ENTRIES}, o AS (SELECT DISTINCT o_orderpriority AS symbol, date_trunc('year', o_orderdate) AS a, date_trunc('year', o_orderdate) + INTERVAL 100 DAY AS b FROM orders), "
    "m AS (SELECT o.symbol, o.a, o.b, e.id, list_filter(e.hashes, lambda h: h <> 'c1' AND h <> 'c2') AS hs FROM o JOIN e ON (e.symbol IS NULL OR e.symbol = o.symbol) AND e.a <= o.b AND e.b >= o.a), "
    "h AS (SELECT symbol, a, b, count(DISTINCT x) AS n FROM (SELECT symbol, a, b, unnest(hs) AS x FROM m) GROUP BY ALL) "
    "SELECT o.symbol, o.a AS window_start, o.b AS window_end, count(DISTINCT m.id) AS n_sweeps, coalesce(max(h.n), 0) AS n_configs FROM o LEFT JOIN m USING (symbol, a, b) LEFT JOIN h USING (symbol, a, b) GROUP BY ALL"
)
def prior_sweep_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a ledger of earlier sweeps: how many overlap each year's first hundred days, with how many other configurations."""
    orders = T.table(spark, sf, "orders")
    later = lambda day, n: F.timestamp_add("DAY", n, day)
    entries = orders.filter("o_orderkey % 17 <> 0").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("symbol"), F.col("o_orderdate").alias("window_start"), later(F.col("o_orderdate"), F.col("o_orderkey") % 60).alias("window_end"),
        F.array(F.concat(F.lit("c"), F.col("o_orderkey") % 7), F.concat(F.lit("c"), F.col("o_custkey") % 13)).alias("config_hashes"),
    )
    year = F.date_trunc("year", "o_orderdate").cast("timestamp_ntz")
    own = orders.select(F.col("o_orderpriority").alias("symbol"), year.alias("window_start")).distinct().select("symbol", "window_start", later(F.col("window_start"), F.lit(100)).alias("window_end"), F.array(F.lit("c1"), F.lit("c2")).alias("config_hashes"))
    return sweeps.prior_trials(entries, own)


# ---- combinatorial paths -----------------------------------------------------
GROUPS, TESTED, PURGE = 6, 2, 5
_SPLITS = list(itertools.combinations(range(GROUPS), TESTED))
_BOUND = "CASE WHEN pos < (n % 6) * (n // 6 + 1) THEN pos // (n // 6 + 1) ELSE n % 6 + (pos - (n % 6) * (n // 6 + 1)) // (n // 6) END"
_PATHS = (
    f"{PERF}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM perf WHERE ret IS NOT NULL)), "
    f"gd AS (SELECT date, pos, ({_BOUND})::INTEGER AS grp FROM days), ends AS (SELECT grp, min(pos) AS a, max(pos) AS b FROM gd GROUP BY 1), "
    f"tested(split, grp) AS (VALUES {','.join(f'({c},{g})' for c, x in enumerate(_SPLITS) for g in x)}), "
    "rows_ AS MATERIALIZED (SELECT name, pos, grp, ret, lag(ret) OVER (PARTITION BY name ORDER BY pos) AS before FROM perf JOIN gd USING (date) WHERE ret IS NOT NULL), "
    f"near AS (SELECT DISTINCT split, pos FROM tested JOIN ends USING (grp), gd WHERE pos BETWEEN a - {PURGE} AND b + {PURGE}), "
    "fit AS (SELECT name, split, covar_pop(ret, before) / var_pop(before) AS slope, avg(ret) - covar_pop(ret, before) / var_pop(before) * avg(before) AS level FROM rows_, range(15) s(split) WHERE before IS NOT NULL AND (split, pos) NOT IN (SELECT split, pos FROM near) GROUP BY ALL), "
    "seg AS (SELECT split, grp, row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path FROM tested), "
    "pth AS (SELECT path, r.name, split, pos, level + slope * before AS p, ret FROM rows_ r JOIN seg USING (grp) JOIN fit f USING (name, split) WHERE before IS NOT NULL)"
)


def _predictions(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """(name, split, pos, p, ret): next returns by a line on the last one, fitted on each split's purged training days; and the number of days."""
    perf = _perf(spark, sf)
    days = perf.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))
    n = days.count()
    rows = perf.join(days, "date").withColumn("before", F.lag("ret").over(Window.partitionBy("name").orderBy("pos"))).filter("before IS NOT NULL")
    size, longer = divmod(n, GROUPS)
    edge = [g * size + min(g, longer) for g in range(GROUPS + 1)]
    table = spark.createDataFrame([(c, [(edge[g], edge[g + 1] - 1) for g in x]) for c, x in enumerate(_SPLITS)], "split int, spans array<struct<a:long,b:long>>")
    each = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(len(_SPLITS) - 1)))).join(F.broadcast(table), "split")
    pos = F.col("pos")
    near = F.exists("spans", lambda s: (pos >= s["a"] - PURGE) & (pos <= s["b"] + PURGE))
    slope = F.covar_pop("ret", "before") / F.var_pop("before")
    fit = each.filter(~near).groupBy("name", "split").agg(slope.alias("slope"), (F.avg("ret") - slope * F.avg("before")).alias("level"))
    tests = each.filter(F.exists("spans", lambda s: (pos >= s["a"]) & (pos <= s["b"])))
    return tests.join(fit, ["name", "split"]).select("name", "split", "pos", (F.col("level") + F.col("slope") * F.col("before")).alias("p"), "ret"), n


@register(f"WITH {_PATHS} SELECT path::INTEGER AS path, name, split, pos, p, ret FROM pth")
def cpcv_prediction_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of the combinatorial splits over a table of predictions; each has all days once."""
    made, n = _predictions(spark, sf)
    return splits.assemble_paths(made, n, GROUPS, TESTED, ["name"])


@register(f"WITH {_PATHS}, q AS (SELECT path, name, sign(p) * ret AS x FROM pth) SELECT path::INTEGER AS path, name, count(*) AS days, avg(x) / stddev_samp(x) AS sr, sum(x) AS total FROM q GROUP BY ALL")
def cpcv_path_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """The ratio that a sign rule has on each path: a distribution, where walk-forward has one."""
    made, n = _predictions(spark, sf)
    x = F.signum("p") * F.col("ret")
    return splits.assemble_paths(made, n, GROUPS, TESTED, ["name"]).groupBy("path", "name").agg(F.count(F.lit(1)).alias("days"), (F.avg(x) / F.stddev_samp(x)).alias("sr"), F.sum(x).alias("total"))


# ---- cycles ------------------------------------------------------------------
@register()
def seasonal_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the week in which a pool's mean move pays for the trade into it, and the positions held through the others."""
    rows = learning_queries.pooled_bars(spark, sf).withColumn("slot", (F.weekday("time") * 24 + F.hour("time")).cast("int"))
    ahead = F.ln(F.lead("close").over(Window.partitionBy("series_id").orderBy("time")) / F.col("close"))
    rows = rows.withColumn("ahead", ahead)
    own = rows.groupBy("series_id").agg(F.avg("ahead").alias("mean"), F.var_pop("ahead").alias("gamma"))
    n = F.count("ahead")
    slots = rows.join(own, "series_id").groupBy("series_id", "slot").agg(((F.avg("ahead") - F.first("mean")) * n / (n + 5)).alias("edge"), F.avg(F.col("spread") / F.col("close")).alias("cost"), F.first("gamma").alias("gamma"))
    return cycles.cycle_positions(slots, ["series_id"])


# ---- snapshots ---------------------------------------------------------------
_NEAR = ["meanrev", "range", "microstructure", "session", "calendar"]


@register(f"SELECT * FROM (SELECT b.*, {', '.join(f'{g}.* EXCLUDE (time)' for g in _NEAR)} FROM (WITH {BARS} SELECT {BAR_COLS} FROM bars) b {' '.join(f'JOIN ({feature_queries._SQL[f"features_{g}"]}) {g} ON {g}.time = b.time' for g in _NEAR)}) QUALIFY row_number() OVER (ORDER BY time DESC) <= 48")
def feature_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Five groups on the newest 48 hourly bars, from no more bars than the groups look back; SQL takes them from all bars."""
    pipe = features.Pipeline(_NEAR)
    return warmup.snapshot(pipe, T.bars(spark, sf), 48, events=T.calendar(spark, sf))


# ---- decisions that wait -----------------------------------------------------
_RULE = retries.Retry(most_wait=200_000.0, wait=1800.0, longest=40_000.0)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as purchases that decide and other events that look whether the market is open."""
    e = T.table(spark, sf, "events")
    decides = F.col("event_type") == "purchase"
    lots = lambda k: F.when(decides, F.col("event_id") % k - (k // 2)).cast("double")
    return e.select(F.col("user_id").alias("series_id"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.when(decides, "decision").otherwise("poll").alias("kind"), lots(5).alias("target"), lots(7).alias("current"), (~decides & (F.col("event_id") % 4 == 0)).alias("open"))


@register(
    "WITH RECURSIVE e AS (SELECT user_id AS s, epoch_us(ts) AS t, event_type = 'purchase' AS d, (event_id % 5 - 2)::DOUBLE AS target, (event_id % 7 - 3)::DOUBLE AS cur, event_type <> 'purchase' AND event_id % 4 = 0 AS open, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "st AS (SELECT s, 0::BIGINT AS n, NULL::BIGINT AS pt, 0.0::DOUBLE AS pg, 0.0::DOUBLE AS pc, 0 AS tries, 0::BIGINT AS nx, NULL::BIGINT AS o1, 0.0::DOUBLE AS og, NULL::VARCHAR AS oc, 0::BIGINT AS oat, 0 AS otr FROM (SELECT DISTINCT s FROM e) "
    "UNION ALL SELECT s, n, CASE WHEN d THEN t WHEN ex OR done THEN NULL ELSE pt END, CASE WHEN d THEN target ELSE pg END, CASE WHEN d THEN cur ELSE pc END, CASE WHEN d THEN 0 WHEN go THEN tries + 1 ELSE tries END, "
    f"CASE WHEN d THEN t WHEN go THEN t + round(least({_RULE.wait} * pow(2, least(tries + 1, 10)), {_RULE.longest}) * 1000000)::BIGINT ELSE nx END, "
    "CASE WHEN ex OR sup OR done THEN pt END, pg, CASE WHEN ex THEN 'expired' WHEN sup THEN 'superseded' WHEN done THEN 'executed' END, CASE WHEN ex THEN pe ELSE t END, CASE WHEN done THEN tries + 1 ELSE tries END "
    "FROM (SELECT *, d AND pt IS NOT NULL AND NOT ex AS sup, NOT d AND pt IS NOT NULL AND NOT ex AND t >= nx AS go, NOT d AND pt IS NOT NULL AND NOT ex AND t >= nx AND open AS done FROM (SELECT st.s, e.n, t, d, target, cur, open, pt, pg, pc, tries, nx, pe, coalesce(t > pe, false) AS ex "
    f"FROM (SELECT *, CASE WHEN pt IS NOT NULL AND NOT (abs(pg) < abs(pc) - 1e-9 AND (abs(pg) < 1e-9 OR (pg > 0) = (pc > 0))) THEN pt + {round(_RULE.most_wait * 1e6)} END AS pe FROM st) st JOIN e ON e.s = st.s AND e.n = st.n + 1))) "
    "SELECT s AS series_id, make_timestamp(o1) AS decision_time, og AS target, oc AS outcome, make_timestamp(oat) AS at, otr AS attempts FROM st WHERE oc IS NOT NULL"
)
def deferred_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every user's decisions that had to wait for an open market."""
    out = retries.retried(decisions(spark, sf), _RULE)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("decision_time", "at")})


@register(
    f"WITH {learning_queries._FEATURED.split(', f0 AS')[0]}, b AS (SELECT *, time + INTERVAL 1 HOUR AS av FROM bars), f AS (SELECT user_id % {learning_queries.POOLS} AS series_id, ts AS time, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, value + 1 AS price, event_id FROM events WHERE event_type = 'purchase'), "
    "g AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN price * (1 - side * 0.5::DOUBLE) END AS sl, CASE WHEN event_id % 3 <> 0 THEN price * (1 + side * 0.9::DOUBLE) END AS tp, lead(time) OVER (PARTITION BY series_id ORDER BY time) AS til FROM f), "
    "x AS (SELECT g.series_id, g.time, side, av, open, CASE WHEN (side > 0 AND open <= sl) OR (side < 0 AND open >= sl) THEN 'so' WHEN (side > 0 AND open >= tp) OR (side < 0 AND open <= tp) THEN 'to' WHEN (side > 0 AND low <= sl) OR (side < 0 AND high >= sl) THEN 'sl' WHEN (side > 0 AND high >= tp) OR (side < 0 AND low <= tp) THEN 'tp' END AS k, sl, tp "
    "FROM g JOIN b ON b.series_id = g.series_id AND av > g.time AND (til IS NULL OR av <= til)) "
    "SELECT series_id, time, side::INTEGER AS side, CASE WHEN k IN ('so', 'sl') THEN 'stop' ELSE 'target' END AS reason, av AS exit_time, CASE k WHEN 'sl' THEN sl WHEN 'tp' THEN tp ELSE open END AS price FROM x WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, time, side ORDER BY av) = 1"
)
def protective_exits(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as fills with levels: which of them a later bar has closed, and how."""
    e = T.table(spark, sf, "events").filter("event_type = 'purchase'")
    side, price = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1), F.col("value") + 1
    fills = e.select((F.col("user_id") % learning_queries.POOLS).alias("series_id"), F.col("ts").alias("time"), side.alias("side"), F.when(F.col("event_id") % 5 != 0, price * (1 - side * 0.5)).alias("sl"), F.when(F.col("event_id") % 3 != 0, price * (1 + side * 0.9)).alias("tp"))
    return retries.protective_exits(fills, learning_queries.pooled_bars(spark, sf))


# ---- regimes -----------------------------------------------------------------
@register()
def regime_states(spark: SparkSession, sf: str) -> DataFrame:
    """Two regimes of each pool by its move and its range, fitted on its first two weeks from several starts; filtered throughout."""
    rows = learning_queries.pooled_bars(spark, sf)
    found = regimes.regime_probabilities(rows, ["mom_1", "range_1"], "2024-01-15", restarts=3, rounds=20)
    return found.select("series_id", "time", F.get("p", F.lit(0)).alias("p_calm"), "state", "score")


# ---- the desk ----------------------------------------------------------------
_SHIFT = snapshots.shift_days("2024-01-01")


@register(
    f"WITH {BARS}, {MACRO}, {CALENDAR}, s AS (SELECT *, close / lag(close, 1) {W} - 1 AS ret_1, close / lag(close, 5) {W} - 1 AS ret_5, close / lag(close, 20) {W} - 1 AS ret_20, {g(f'close / avg(close) {w(50)} - 1', 'close', 50)} AS from_mean_50 FROM bars), "
    "m AS (SELECT event_id, ts AS now FROM events WHERE event_type = 'signup'), j AS (SELECT m.*, s.* FROM m ASOF LEFT JOIN s ON m.now >= s.available_at), "
    "mv AS (SELECT event_id, arg_max(value, date) FILTER (WHERE name LIKE '1%') AS urgent, count(DISTINCT name) AS n_macro FROM m JOIN macro ON macro.available_at <= now GROUP BY 1), "
    "ev AS (SELECT event_id, count(*) FILTER (WHERE c.time > now) AS n_upcoming, count(*) FILTER (WHERE c.time <= now) AS n_past, min(c.time) FILTER (WHERE c.time > now) AS next_time, max(c.time) FILTER (WHERE c.time <= now) AS last_time FROM m JOIN calendar c ON c.time <= now + INTERVAL 6 HOUR AND c.time >= now - INTERVAL 3 HOUR GROUP BY 1) "
    f"SELECT event_id, now + INTERVAL {_SHIFT} DAY AS now, time + INTERVAL {_SHIFT} DAY AS bar_time, ret_1, ret_5, ret_20, from_mean_50, urgent, coalesce(n_macro, 0) AS n_macro, coalesce(n_upcoming, 0) AS n_upcoming, coalesce(n_past, 0) AS n_past, next_time + INTERVAL {_SHIFT} DAY AS next_time, last_time + INTERVAL {_SHIFT} DAY AS last_time FROM j LEFT JOIN mv USING (event_id) LEFT JOIN ev USING (event_id)"
)
def desk_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """What could be known at every signup, with dates moved and prices rebased."""
    moments = T.table(spark, sf, "events").filter("event_type = 'signup'").select("event_id", F.col("ts").alias("now"))
    stats = snapshots.bar_statistics(T.bars(spark, sf), means=(50,))
    found = snapshots.snapshots(moments, stats, macro=T.macro(spark, sf), events=T.calendar(spark, sf), ahead_hours=6, back_hours=3, shift=_SHIFT, listed=False)
    size = lambda c: F.size(c).cast("long")
    urgent = F.element_at("macro", F.filter(F.map_keys("macro"), lambda k: k.startswith("1"))[0])
    return found.select("event_id", "now", "bar_time", "ret_1", "ret_5", "ret_20", "from_mean_50", urgent.alias("urgent"), F.when(F.col("macro").isNotNull(), size("macro")).otherwise(0).alias("n_macro"), "n_upcoming", "n_past", "next_time", "last_time")


_PRICES = [("click", 3.0, 15.0), ("view", 1.0, 5.0), ("error", 0.25, 1.25), ("purchase", 5.0, 25.0)]


@register(
    f"WITH p(model, pi, po) AS (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES)}), c AS (SELECT 'agent ' || (user_id % 50) AS agent, event_type AS model, event_id % 1000 AS i, event_id % 300 AS o, event_id % 70 AS cw, event_id % 900 AS cr, event_id % 23 = 0 AS free FROM events), "
    "d AS (SELECT agent, CASE WHEN free THEN 0 ELSE i + o + cw + cr END AS tokens, CASE WHEN free THEN i + cw + cr ELSE 0 END AS unbilled, CASE WHEN free THEN 0 ELSE (coalesce(pi, 5) * (i + 1.25::DOUBLE * cw + 0.1::DOUBLE * cr) + coalesce(po, 25) * o) / 1000000 END AS cost FROM c LEFT JOIN p USING (model)), "
    "s AS (SELECT agent, count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum(unbilled)::BIGINT AS unbilled, sum(round(cost * 1000000000)::BIGINT)::DOUBLE / 1000000000 AS cost FROM d GROUP BY GROUPING SETS ((agent), ())) SELECT *, greatest(0, cost / 1.5::DOUBLE, tokens / 200000) AS used, greatest(0, cost / 1.5::DOUBLE, tokens / 200000) >= 1 AS over FROM s"
)
def usage_by_agent(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of agents to models: tokens, costs and shares of the budgets, by agent and in all."""
    n = lambda k: F.col("event_id") % k
    calls = T.table(spark, sf, "events").select(F.concat(F.lit("agent "), F.col("user_id") % 50).alias("agent"), F.col("event_type").alias("model"), n(1000).alias("input"), n(300).alias("output"), n(70).alias("cache_write"), n(900).alias("cache_read"), (n(23) == 0).alias("declined"))
    return snapshots.usage_summary(snapshots.usage_costs(calls, spark.createDataFrame(_PRICES, snapshots.PRICED)), ["agent"], most_cost=1.5, most_tokens=200_000)


# ---- reports -----------------------------------------------------------------
_ZQ = normal_quantile(0.05)
_DENSITY = 0.3989422804014327 * 2.718281828459045 ** (-_ZQ * _ZQ / 2)


@register(
    "WITH p AS (SELECT o_orderpriority AS name, o_orderdate::DATE AS date, sum(o_totalprice) AS equity, max(o_totalprice) AS held FROM orders GROUP BY ALL), r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, 1 - equity / max(equity) OVER w AS dd FROM p WINDOW w AS (PARTITION BY name ORDER BY date)), "
    "q AS (SELECT *, CASE WHEN count(r) OVER b = 100 THEN quantile_cont(r, 0.05) OVER b END AS q FROM r WINDOW b AS (PARTITION BY name ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)), "
    "m AS (SELECT *, avg(r) OVER (PARTITION BY name) AS av FROM q), "
    "s AS (SELECT name, count(r) AS periods, arg_max(equity, date) AS last_equity, arg_max(held, date) AS x, quantile_cont(r, 0.05) AS vq, avg(r) AS mean, stddev_samp(r) AS sd, sum(pow(r - av, 3)) / count(r) / pow(stddev_pop(r), 3) AS skew, sum(pow(r - av, 4)) / count(r) / pow(stddev_pop(r), 4) AS kurt, min(r) AS worst, max(r) AS best, max(dd) AS max_drawdown, arg_max(dd, date) AS current_drawdown, count(q) AS tests, count(*) FILTER (WHERE r < q) AS breaches FROM m GROUP BY name), "
    "t AS (SELECT name, avg(r) FILTER (WHERE r <= vq) AS tail FROM q JOIN s USING (name) GROUP BY name), "
    f"k AS (SELECT *, greatest(-2 * ((tests - breaches) * {math.log(0.95)!r}::DOUBLE + breaches * {math.log(1 - 0.95)!r}::DOUBLE - CASE WHEN tests > breaches THEN (tests - breaches) * ln(1 - breaches / tests) ELSE 0 END - CASE WHEN breaches > 0 THEN breaches * ln(breaches / tests) ELSE 0 END), 0) AS kupiec FROM s JOIN t USING (name)) "
    f"SELECT name, periods, last_equity, -vq AS var_historical, greatest(-tail, -vq) AS es_historical, -(mean + {_ZQ!r}::DOUBLE * sd) AS var_gaussian, -(mean - {_DENSITY!r}::DOUBLE / 0.05::DOUBLE * sd) AS es_gaussian, "
    f"-(mean + ({_ZQ!r}::DOUBLE + {_ZQ * _ZQ - 1!r}::DOUBLE * skew / 6 + {_ZQ**3 - 3 * _ZQ!r}::DOUBLE * (kurt - 3) / 24 - {2 * _ZQ**3 - 5 * _ZQ!r}::DOUBLE * skew * skew / 36) * sd) AS var_cornish_fisher, mean, sd, skew, kurt, worst, best, max_drawdown, current_drawdown, tests, breaches, kupiec, 2 * {phi('-sqrt(kupiec)')} AS kupiec_p, x * -0.1::DOUBLE / last_equity AS gap_down, x * 0.1::DOUBLE / last_equity AS gap_up FROM k"
)
def risk_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Every priority's daily total as an account, the day's largest order as what it holds."""
    rows = T.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("equity"), F.max("o_totalprice").alias("held"))
    return reports.risk_report(rows, ["name"], window=100, exposure="held", shocks={"gap_down": -0.1, "gap_up": 0.1})


# ---- what a combination rests on ---------------------------------------------
_FITTED = evidence._SQL["combiner_inverse_vol"].rsplit("SELECT strategy, weight, fdm FROM wt, fd", 1)[0]


@register(
    f"{_FITTED}SELECT strategy, weight, fdm, sr * sqrt(252::DOUBLE) AS sharpe, sr_gross * sqrt(252::DOUBLE) AS sharpe_gross, turnover, cost, (SELECT avg(abs(CASE strategy WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END)) FROM fs WHERE nx IS NOT NULL) AS mean_size, (kab + kac + kbc) / 3 AS mean_corr, greatest(1 - (SELECT sum(weight) FROM wt), 0)::DOUBLE AS unallocated FROM wt JOIN stt USING (strategy), fd, co"
)
def combiner_explained(spark: SparkSession, sf: str) -> DataFrame:
    """The combination of three rules by inverse volatility, and what it rests on."""
    rows, names = evidence._three(spark, sf), ["a", "b", "c"]
    return combination.explain(rows, names, COSTS, combination.fit(rows, names, COSTS, method="inverse_vol", largest=0.9))


@register(
    f"{_FITTED}SELECT time, contribution_a, contribution_b, contribution_c, greatest(least(total, 0.5), -0.5)::DOUBLE AS combined, total - greatest(least(total, 0.5), -0.5) AS clipped FROM (SELECT *, contribution_a + contribution_b + contribution_c AS total FROM (SELECT time, a * wa * fdm AS contribution_a, b * wb * fdm AS contribution_b, c * wc * fdm AS contribution_c FROM fs, pv, fd))"
)
def decision_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """What each rule adds to the combined forecast of every bar, and what the limit cuts off."""
    rows, names = evidence._three(spark, sf), ["a", "b", "c"]
    fitted = combination.fit(rows, names, COSTS, method="inverse_vol", largest=0.9)
    return combination.attribution(rows, names, fitted, 0.5).select("time", "contribution_a", "contribution_b", "contribution_c", "combined", "clipped")


# ---- across time frames ------------------------------------------------------
def _cross_sql() -> str:
    ticks = learning_queries._FEATURED.split(", f0 AS")[0]
    over = lambda f, n, c: f"CASE WHEN count({c}) {w(n)} = {n} THEN {f}({c}) {w(n)} END"
    own = f"{over('stddev_samp', 20, 'r')} AS volatility, close / lag(close, 10) {W} - 1 AS momentum, CASE WHEN count(close) {w(30)} = 30 THEN CASE WHEN avg(close) {w(10)} > avg(close) {w(30)} THEN 1.0 ELSE -1.0 END END::DOUBLE AS trend, close / ({over('max', 20, 'high')}) - 1 AS to_high, close / ({over('min', 20, 'low')}) - 1 AS to_low"
    feats = lambda src: f"SELECT *, {own} FROM (SELECT *, close / lag(close) {W} - 1 AS r FROM {src})"
    big = lambda name, width: (
        f"{name}r AS (SELECT series_id, time_bucket(INTERVAL {width}, time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, greatest(max(av), time_bucket(INTERVAL {width}, time) + INTERVAL {width}) AS av, max(av) AS la, min(time) AS ft FROM b1 GROUP BY series_id, time_bucket(INTERVAL {width}, time)), "
        f"{name}k AS (SELECT * FROM {name}r QUALIFY (time > min(time) OVER (PARTITION BY series_id) OR ft = time) AND (time < max(time) OVER (PARTITION BY series_id) OR la >= time + INTERVAL {width})), {name}f AS ({feats(f'{name}k')})"
    )
    cols = lambda n, f: ", ".join(f"{f}.{c} AS {n}_{c}" for c in crossframes.OWN)
    each = lambda c: [f"{n}_{c}" for n in ("base", "h4", "d1")]
    known = lambda c: "(" + " + ".join(f"({x} IS NOT NULL)::INTEGER" for x in each(c)) + ")"
    t = each("trend")
    mean = f"(({' + '.join(f'coalesce({x}, 0)' for x in t)}) / nullif({known('trend')}, 0))"
    near = lambda c, test: f"({' + '.join(f'coalesce({x} {test}, false)::INTEGER' for x in each(c))}) / nullif({known(c)}, 0)"
    agree = lambda s: " AND ".join(f"coalesce({x} {s} 0, false)" for x in each("momentum"))
    avg = lambda n: f"CASE WHEN count(base_volatility) {w(n)} = {n} THEN avg(base_volatility) {w(n)} END"
    return (
        f"WITH {ticks}, b1 AS (SELECT *, time + INTERVAL 1 HOUR AS av FROM bars), f1 AS ({feats('b1')}), {big('h4', '4 HOUR')}, {big('d1', '1 DAY')}, "
        f"j AS (SELECT f1.series_id, f1.time, {cols('base', 'f1')}, {cols('h4', 'h4f')}, {cols('d1', 'd1f')} FROM f1 ASOF LEFT JOIN h4f ON f1.series_id = h4f.series_id AND f1.av >= h4f.av ASOF LEFT JOIN d1f ON f1.series_id = d1f.series_id AND f1.av >= d1f.av) "
        f"SELECT *, {mean} AS trend_alignment, CASE WHEN {known('trend')} > 0 THEN {' * '.join(f'coalesce({x}, 1)' for x in t)} END AS trend_cascade, CASE WHEN {known('trend')} > 1 THEN sqrt(({' + '.join(f'coalesce(pow({x} - {mean}, 2), 0)' for x in t)}) / ({known('trend')} - 1)) END AS trend_divergence, "
        f"h4_momentum * base_momentum AS momentum_h4_base, d1_momentum * h4_momentum AS momentum_d1_h4, base_volatility / nullif({avg(100)}, 0) AS vol_regime, (base_volatility > 2 * ({avg(20)}))::INTEGER::DOUBLE AS vol_spike, (base_volatility < ({avg(20)}) / 2)::INTEGER::DOUBLE AS vol_compression, "
        f"{near('to_low', '< 0.02')} AS support, {near('to_high', '> -0.02')} AS resistance, (({agree('>')})::INTEGER - ({agree('<')})::INTEGER)::DOUBLE AS breakout FROM j"
    )


@register(_cross_sql())
def cross_frame_features(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of pools with what finished bars of four hours and of a day say, and how the frames agree."""
    ticks = T.ticks(spark, sf).withColumns({"series_id": F.col("series_id") % learning_queries.POOLS, "spread": 0.1 + 0.001 * (F.col("seq") % 50)})
    out = crossframes.cross_features(ticks_to_bars(ticks, "1 hour"), {"h4": "4 hours", "d1": "1 day"})
    return out.drop("open", "high", "low", "close", "volume", "spread", "available_at")
