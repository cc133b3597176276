"""Registered queries of walk-forward learning, and SQL that grows the same trees round by round."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators import labels as lb
from chronosift.operators import splits
from chronosift.operators.resample import ticks_to_bars
from chronosift.operators.rolling import series
from chronosift.plans import learning
from chronosift.plans.evidence import phi
from chronosift.plans.market import _AGG
from chronosift.sources import tables as T
from chronosift.sources.store import Steps

_Q: dict = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: Series that the ticks are pooled into, bars of a look-back and of a label, spans of the folds.
POOLS, BACK, HORIZON, STRIDE = 8, 20, 10, 2
TRAIN, TEST, EMBARGO = 300, 100, 2
FEATURES = ["mom_1", "mom_5", "mom_20", "range_1", "vol_20", "volume_20"]
LEARNER = learning.Learner(rounds=4, depth=2, embargo=EMBARGO)


def pooled_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of pools of users, with pos, features and the size of barriers."""
    ticks = T.ticks(spark, sf).withColumns({"series_id": F.col("series_id") % POOLS, "spread": 0.1 + 0.001 * (F.col("seq") % 50)})
    rows = ticks_to_bars(ticks, "1 hour").withColumn("pos", (F.row_number().over(series()) - 1).cast("long"))
    back = lambda n: F.ln(F.col("close") / F.lag("close", n).over(series()))
    rows = rows.withColumns({"mom_1": back(1), "mom_5": back(5), "mom_20": back(20), "range_1": (F.col("high") - F.col("low")) / F.col("close")})
    full = series().rowsBetween(-(BACK - 1), 0)
    vol = F.when(F.count("mom_1").over(full) == BACK, F.stddev_samp("mom_1").over(full))
    return rows.withColumns({"vol_20": vol, "volume_20": F.when(F.count("volume").over(full) == BACK, F.col("volume") / F.avg("volume").over(full))})


def folds_of(rows: DataFrame) -> list[dict]:
    longest = rows.agg(F.max("pos")).head()[0]
    return splits.walk_forward(0 if longest is None else longest + 1, TRAIN, TEST, embargo=EMBARGO)


_FEATURED = (
    f"ticks AS (SELECT user_id % {POOLS} AS series_id, ts AS time, value + 1 AS price, event_id AS seq, 0.1 + 0.001 * (event_id % 50)::DOUBLE AS spread FROM events), "
    f"bars AS (SELECT series_id, date_trunc('hour', time) AS time, {_AGG} FROM ticks GROUP BY ALL), "
    "f0 AS (SELECT *, row_number() OVER w - 1 AS pos, ln(close / lag(close, 1) OVER w) AS mom_1, ln(close / lag(close, 5) OVER w) AS mom_5, ln(close / lag(close, 20) OVER w) AS mom_20, (high - low) / close AS range_1 FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY time)), "
    f"feats AS MATERIALIZED (SELECT *, CASE WHEN count(mom_1) OVER w = {BACK} THEN stddev_samp(mom_1) OVER w END AS vol_20, CASE WHEN count(volume) OVER w = {BACK} THEN volume / avg(volume) OVER w END AS volume_20 FROM f0 WINDOW w AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN {BACK - 1} PRECEDING AND CURRENT ROW)), "
    f"folds AS (SELECT k::INTEGER AS fold, k * {TEST} AS a, {TRAIN} + k * {TEST} AS b, {TRAIN + EMBARGO} + k * {TEST} AS c, least({TRAIN + TEST + EMBARGO} + k * {TEST}, n) AS d FROM (SELECT max(pos) + 1 AS n FROM feats), range(1000) r(k) WHERE {TRAIN + EMBARGO} + k * {TEST} < n)"
)
_LABELLED = (
    "e AS (SELECT series_id, pos AS t, close, close * exp(vol_20) AS up, close * exp(-vol_20) AS dn FROM feats WHERE vol_20 > 0), "
    f"j AS (SELECT e.*, x.pos AS xt, x.open AS xo, x.high AS xh, x.low AS xl, x.close AS xc FROM e JOIN feats x ON x.series_id = e.series_id AND x.pos BETWEEN e.t + 1 AND e.t + {HORIZON}), "
    "h AS (SELECT series_id, t, arg_min((xt, xo, xh, xl, xc), xt) AS hit FROM j WHERE xh >= up OR xl <= dn GROUP BY ALL), "
    f"z AS (SELECT series_id, t, max(xc) FILTER (WHERE xt = t + {HORIZON}) AS zc FROM j GROUP BY ALL), "
    f"lab AS MATERIALIZED (SELECT e.series_id, e.t AS t_idx, coalesce(hit[1], CASE WHEN zc IS NOT NULL THEN e.t + {HORIZON} END) AS t1_idx, CASE WHEN hit IS NOT NULL AND hit[3] >= up AND hit[4] <= dn THEN CASE WHEN hit[2] >= up THEN 1 WHEN hit[2] <= dn THEN -1 ELSE 0 END "
    "WHEN hit IS NOT NULL AND hit[3] >= up THEN 1 WHEN hit IS NOT NULL THEN -1 WHEN zc IS NOT NULL THEN sign(ln(zc / e.close)) END AS label FROM e LEFT JOIN h USING (series_id, t) LEFT JOIN z USING (series_id, t))"
)
#: Labels of the direction, and of the bets of a side; of both each STRIDE-th event that has features.
_DIRECTION = f"ev AS (SELECT lab.series_id, t_idx, t1_idx, (label > 0)::DOUBLE AS y FROM lab JOIN (SELECT series_id, pos, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS nth FROM feats WHERE {{whole}}) q ON q.series_id = lab.series_id AND q.pos = t_idx AND nth % {STRIDE} = 0 WHERE label <> 0)"
_SIDE = (
    "sides AS (SELECT series_id, pos, coalesce(sign(mom_5), 0)::DOUBLE AS side, coalesce(lag(coalesce(sign(mom_5), 0)) OVER (PARTITION BY series_id ORDER BY pos), 0) AS before FROM feats), "
    "ev AS (SELECT lab.series_id, t_idx, t1_idx, (label * side > 0)::DOUBLE AS y FROM lab JOIN sides s ON s.series_id = lab.series_id AND s.pos = t_idx WHERE label <> 0 AND side <> 0 AND side <> before)"
)


def _cases_sql(events: str) -> str:
    """Cases of every fold with their bins, as table c."""
    whole = " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in FEATURES)
    n, half, fit = len(FEATURES), LEARNER.bins // 2, "part = 'fit'"
    stats = ", ".join(f"avg(x[{i}]) FILTER (WHERE {fit}) AS m{i}, stddev_pop(x[{i}]) FILTER (WHERE {fit}) AS s{i}" for i in range(1, n + 1))
    bins = ", ".join(f"(greatest(least(floor(2 * CASE WHEN s{i} > 0 THEN (x[{i}] - m{i}) / s{i} ELSE 0.0::DOUBLE END), {half - 1}), {-half}) + {half})::INTEGER" for i in range(1, n + 1))
    return (
        f"{_FEATURED}, {_LABELLED}, {events.format(whole=whole)}, "
        f"ready AS MATERIALIZED (SELECT series_id, pos, [{', '.join(FEATURES)}] AS x FROM feats WHERE {whole}), "
        "tr AS MATERIALIZED (SELECT ev.series_id, fold, t_idx, t1_idx, y, x FROM ev JOIN ready ON ready.series_id = ev.series_id AND ready.pos = ev.t_idx JOIN folds ON t_idx >= a AND t_idx < b AND t1_idx < b), "
        "act AS MATERIALIZED (SELECT f.series_id, fold, f.pos, (SELECT count(*) FROM tr WHERE tr.series_id = f.series_id AND tr.fold = folds.fold AND f.pos > t_idx AND f.pos <= t1_idx) AS active FROM feats f JOIN folds ON f.pos >= a AND f.pos < b), "
        "uq AS (SELECT tr.series_id, tr.fold, t_idx, t1_idx, y, x, coalesce(avg(1.0::DOUBLE / active), 1.0::DOUBLE) AS u FROM tr LEFT JOIN act ON act.series_id = tr.series_id AND act.fold = tr.fold AND act.pos > t_idx AND act.pos <= t1_idx GROUP BY ALL), "
        f"ba AS (SELECT *, u / avg(u) OVER k AS w, row_number() OVER (PARTITION BY series_id, fold ORDER BY t_idx DESC) <= ceil(count(*) OVER k * {LEARNER.validate}) AS val FROM uq WINDOW k AS (PARTITION BY series_id, fold)), "
        "pa AS (SELECT *, min(t_idx) FILTER (WHERE val) OVER (PARTITION BY series_id, fold) AS first FROM ba), "
        f"all_ AS MATERIALIZED (SELECT series_id, fold, t_idx AS pos, CASE WHEN val THEN 'val' ELSE 'fit' END AS part, y, w, u, x FROM pa WHERE val OR t1_idx + {LEARNER.embargo} < first "
        "UNION ALL SELECT r.series_id, fold, r.pos, 'test', NULL, 0.0, 0.0, x FROM ready r JOIN folds ON r.pos >= c AND r.pos < d), "
        f"st AS (SELECT series_id, fold, {stats}, sum(w) FILTER (WHERE {fit} AND y > 0) AS nu, sum(w) FILTER (WHERE {fit} AND y <= 0) AS nd FROM all_ GROUP BY ALL HAVING nu > 0 AND nd > 0), "
        f"c AS MATERIALIZED (SELECT series_id, fold, pos, part, y, CASE WHEN {fit} THEN w * ((nu + nd) / 2 / CASE WHEN y > 0 THEN nu ELSE nd END) ELSE w END AS w, u, [{bins}] AS bins FROM all_ JOIN st USING (series_id, fold))"
    )


def _evaluate(source: str, name: str) -> str:
    """Table `name`: source with margin m of all rounds."""
    steps, before = [], source
    for r in range(LEARNER.rounds):
        cols = f"{before}.*" if r == 0 else f"{before}.* EXCLUDE (m)"
        m = "0.0::DOUBLE" if r == 0 else "m"
        out = name if r == LEARNER.rounds - 1 else f"{name}{r}"
        one = "2 + (x1.node IS NOT NULL AND bins[x1.feature + 1] > x1.bin)::INTEGER"
        two = f"2 * ({one}) + (x2.node IS NOT NULL AND bins[x2.feature + 1] > x2.bin)::INTEGER"
        steps.append(
            f"{out} AS MATERIALIZED (SELECT {cols}, {m} + coalesce(v.value, 0.0) AS m FROM {before} LEFT JOIN b{r}_1 x1 ON x1.series_id = {before}.series_id AND x1.fold = {before}.fold AND x1.node = 1 "
            f"LEFT JOIN b{r}_2 x2 ON x2.series_id = {before}.series_id AND x2.fold = {before}.fold AND x2.node = {one} "
            f"LEFT JOIN v{r} v ON v.series_id = {before}.series_id AND v.fold = {before}.fold AND v.node = {two})"
        )
        before = out
    return ", ".join(steps)


def _grown_sql(events: str) -> str:
    """Cases with margins m and calibrated p, as table s; cl has a and b."""
    l2, steps, before = LEARNER.l2, [], "c"
    key = "series_id, fold"
    for r in range(LEARNER.rounds):
        m = "0.0::DOUBLE" if r == 0 else "m"
        steps.append(f"g{r}_1 AS MATERIALIZED (SELECT *, 1 AS node, w * (p - y) AS g, w * p * (1 - p) AS h FROM (SELECT {key}, pos, y, w, bins, 1 / (1 + exp(-{m})) AS p FROM {before} WHERE part = 'fit'))")
        for level in (1, 2):
            steps.append(
                f"t{r}_{level} AS (SELECT {key}, node, feature, bin, sum(g) AS g, sum(h) AS h FROM (SELECT {key}, node, g, h, unnest(range(len(bins))) AS feature, unnest(bins) AS bin FROM g{r}_{level}) GROUP BY ALL), "
                f"u{r}_{level} AS (SELECT *, sum(g) OVER k AS gl, sum(h) OVER k AS hl, sum(g) OVER o AS gt, sum(h) OVER o AS ht FROM t{r}_{level} WINDOW k AS (PARTITION BY {key}, node, feature ORDER BY bin), o AS (PARTITION BY {key}, node, feature)), "
                f"w{r}_{level} AS (SELECT *, round(gl * gl / (hl + {l2}) + (gt - gl) * (gt - gl) / (ht - hl + {l2}) - gt * gt / (ht + {l2}), 9) AS gain FROM u{r}_{level}), "
                f"b{r}_{level} AS MATERIALIZED (SELECT {key}, node, feature, bin FROM w{r}_{level} WHERE hl >= {LEARNER.least_weight} AND ht - hl >= {LEARNER.least_weight} AND gain > 0 QUALIFY row_number() OVER (PARTITION BY {key}, node ORDER BY gain DESC, feature, bin) = 1), "
                f"g{r}_{level + 1} AS MATERIALIZED (SELECT g.* EXCLUDE (node), 2 * g.node + (b.node IS NOT NULL AND g.bins[b.feature + 1] > b.bin)::INTEGER AS node FROM g{r}_{level} g LEFT JOIN b{r}_{level} b ON b.series_id = g.series_id AND b.fold = g.fold AND b.node = g.node)"
            )
        steps.append(f"v{r} AS MATERIALIZED (SELECT {key}, node, -{LEARNER.rate} * sum(g) / (sum(h) + {l2}) AS value FROM g{r}_3 GROUP BY ALL)")
        one = "2 + (x1.node IS NOT NULL AND bins[x1.feature + 1] > x1.bin)::INTEGER"
        two = f"2 * ({one}) + (x2.node IS NOT NULL AND bins[x2.feature + 1] > x2.bin)::INTEGER"
        source = before
        cols = "q.*" if r == 0 else "q.* EXCLUDE (m)"
        same = lambda x: f"{x}.series_id = q.series_id AND {x}.fold = q.fold"
        steps.append(f"c{r} AS MATERIALIZED (SELECT {cols}, {m} + coalesce(v.value, 0.0) AS m FROM {source} q LEFT JOIN b{r}_1 x1 ON {same('x1')} AND x1.node = 1 LEFT JOIN b{r}_2 x2 ON {same('x2')} AND x2.node = {one} LEFT JOIN v{r} v ON {same('v')} AND v.node = {two})")
        before = f"c{r}"
    goal = "CASE WHEN y > 0 THEN (nu + 1) / (nu + 2) ELSE 1 / (nd + 2) END"
    steps.append(f"k0 AS (SELECT {key}, count(*) FILTER (WHERE y > 0)::DOUBLE AS nu, count(*) FILTER (WHERE y <= 0)::DOUBLE AS nd, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {before} WHERE part = 'val' GROUP BY ALL)")
    for i in range(LEARNER.newton):
        steps.append(
            f"n{i} AS (SELECT {key}, nu, nd, a, b, sum(w * (p - goal) * m) AS ga, sum(w * (p - goal)) AS gb, sum(w * p * (1 - p) * m * m) + 0.001 AS aa, sum(w * p * (1 - p) * m) AS ab, sum(w * p * (1 - p)) + 0.001 AS bb "
            f"FROM (SELECT {key}, nu, nd, a, b, m, w, 1 / (1 + exp(-(a * m + b))) AS p, {goal} AS goal FROM {before} JOIN k{i} USING (series_id, fold) WHERE part = 'val') GROUP BY ALL), "
            f"k{i + 1} AS MATERIALIZED (SELECT {key}, nu, nd, a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM n{i})"
        )
    steps.append(f"s AS MATERIALIZED (SELECT q.*, 1 / (1 + exp(-(a * m + b))) AS p FROM {before} q JOIN k{LEARNER.newton} USING (series_id, fold))")
    return f"WITH {_cases_sql(events)}, {', '.join(steps)}"


_GATE = (
    "gp AS (SELECT series_id, fold, p, sum(w) FILTER (WHERE y > 0) AS up, sum(w) FILTER (WHERE y <= 0) AS down FROM s WHERE part = 'val' GROUP BY ALL), "
    "gq AS (SELECT series_id, fold, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(sum(coalesce(down, 0)) OVER (PARTITION BY series_id, fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gp), "
    "au AS (SELECT series_id, fold, sum(up * (below + down / 2)) / nullif(sum(up) * sum(down), 0) AS auc FROM gq GROUP BY ALL), "
    "gn AS (SELECT series_id, fold, count(*) AS n_val, sum(u) AS n_eff, avg((y > 0)::INTEGER) AS nu FROM s WHERE part = 'val' GROUP BY ALL), "
    "gs AS (SELECT *, sqrt((n_eff + 1) / nullif(12 * nu * (1 - nu) * n_eff * n_eff, 0)) AS se FROM gn JOIN au USING (series_id, fold)), "
    "gate AS (SELECT series_id, fold, n_val, n_eff, auc, se, (auc - 0.5) / se AS z, coalesce((auc - 0.5) / se >= {least}, false) AS passed FROM gs)"
)
_GROWN, _BETS = _grown_sql(_DIRECTION), _grown_sql(_SIDE)
_LEAST = 0.5
_OPEN = _GATE.format(least=_LEAST)


def _direction(spark: SparkSession, sf: str) -> learning.Fitted:
    steps = Steps(spark)
    rows = steps.put(pooled_bars(spark, sf), "bars")
    y = lb.triple_barrier(rows, target="vol_20", pt_mult=1.0, sl_mult=1.0, horizon=HORIZON).filter("label <> 0")
    whole = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in FEATURES])
    events = learning.event_positions(rows.filter(whole).select("series_id", "pos"), stride=STRIDE)
    known = y.join(events.withColumnRenamed("pos", "t_idx"), ["series_id", "t_idx"]).select("series_id", "t_idx", "t1_idx", (F.col("label") > 0).cast("double").alias("y"))
    return learning.fit_folds(learning.fold_cases(rows, FEATURES, steps.put(known, "labels"), folds_of(rows), LEARNER, steps), len(FEATURES), LEARNER, steps)


def _bets(spark: SparkSession, sf: str) -> tuple[learning.Fitted, DataFrame]:
    """The models of a momentum rule's bets, and its sides."""
    steps = Steps(spark)
    rows = steps.put(pooled_bars(spark, sf).withColumn("side", F.coalesce(F.signum("mom_5"), F.lit(0.0))), "bars")
    y = learning.sided_labels(rows, "side", target="vol_20", pt_mult=1.0, sl_mult=1.0, horizon=HORIZON)
    events = learning.event_positions(rows.select("series_id", "pos", "side"), kind="flip").select("series_id", F.col("pos").alias("t_idx"))
    sides = steps.put(rows.select("series_id", "pos", "side"), "sides", keep=True)
    known = steps.put(y.join(events, ["series_id", "t_idx"]), "labels")
    return learning.fit_folds(learning.fold_cases(rows, FEATURES, known, folds_of(rows), LEARNER, steps), len(FEATURES), LEARNER, steps), sides


_DEAD = "sign(2 * p - 1) * greatest(abs(2 * p - 1) - 0.02, 0) / 0.98"


@register(
    f"{_GROWN}, {_OPEN}, raw AS (SELECT *, {_DEAD} AS f FROM s), sc AS (SELECT r.series_id, r.fold, CASE WHEN passed AND avg(abs(f)) > 0 THEN least(0.5 / avg(abs(f)), 10.0) ELSE 0.0 END AS scalar FROM raw r JOIN gate USING (series_id, fold) WHERE part = 'val' GROUP BY r.series_id, r.fold, passed) "
    "SELECT series_id, fold, pos, p, scalar::DOUBLE AS scalar, greatest(least(scalar * f, 1.0), -1.0)::DOUBLE AS forecast FROM raw JOIN sc USING (series_id, fold) WHERE part = 'test'"
)
def rule_ml_gbm(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the direction on the test bars of all folds of all pools."""
    return learning.forecast(_direction(spark, sf), learning.direction, least=_LEAST)


_BET = f"CASE WHEN p >= 0.5 THEN greatest(2 * {phi('(p - 0.5) / sqrt(p * (1 - p))')} - 1, 0) ELSE 0 END"


@register(
    f"{_BETS}, {_OPEN}, raw AS (SELECT *, {_BET} AS f FROM s), sc AS (SELECT r.series_id, r.fold, CASE WHEN passed AND avg(abs(f)) > 0 THEN least(0.3 / avg(abs(f)), 10.0) ELSE 0.0 END AS scalar FROM raw r JOIN gate USING (series_id, fold) WHERE part = 'val' GROUP BY r.series_id, r.fold, passed) "
    "SELECT series_id, fold, pos, side, p, scalar::DOUBLE AS scalar, (side * round(greatest(least(scalar * f, 1.0), -1.0) / 0.1) * 0.1)::DOUBLE AS meta_label FROM raw JOIN sc USING (series_id, fold) JOIN sides USING (series_id, pos) WHERE part = 'test' AND side <> 0"
)
def rule_meta_label(spark: SparkSession, sf: str) -> DataFrame:
    """A momentum rule's sides times sizes of bets, on a grid of tenths, on the test bars of all folds of all pools."""
    fitted, sides = _bets(spark, sf)
    sized = learning.forecast(fitted, learning.bet, least=_LEAST, target=0.3)
    return sized.join(sides.filter("side <> 0"), ["series_id", "pos"]).select("series_id", "fold", "pos", "side", "p", "scalar", (F.col("side") * learning.stepped(F.col("forecast"), 0.1)).alias("meta_label"))


@register(f"{_GROWN}, {_OPEN} SELECT series_id, fold, n_val, n_eff, auc, se, z, passed FROM gate")
def ml_skill_gate(spark: SparkSession, sf: str) -> DataFrame:
    return learning.skill_gate(_direction(spark, sf).cases, _LEAST)


_NAMES = "[" + ", ".join(f"'{n}'" for n in FEATURES) + "]"
_MIXED = (
    f"pe AS (SELECT series_id, fold, pos, y, w, bins, p, unnest(range({len(FEATURES)})) AS at_, unnest({_NAMES}) AS feature FROM s WHERE part = 'val'), "
    "pr AS (SELECT *, unnest(range(2)) AS rep FROM pe), "
    "pk AS (SELECT *, row_number() OVER (PARTITION BY series_id, fold, feature, rep ORDER BY pos) AS rk, row_number() OVER (PARTITION BY series_id, fold, feature, rep ORDER BY md5(pos || '|' || feature || '|' || rep), pos) AS dr FROM pr), "
    "px AS (SELECT k.series_id, k.fold, k.feature, k.rep, k.y, k.w, k.p, list_transform(k.bins, lambda b, i: CASE WHEN i = k.at_ + 1 THEN o.bins[k.at_ + 1] ELSE b END) AS bins FROM pk k JOIN pk o ON o.series_id = k.series_id AND o.fold = k.fold AND o.feature = k.feature AND o.rep = k.rep AND o.dr = k.rk)"
)
_LOSS = "-ln(greatest(CASE WHEN y > 0 THEN {0} ELSE 1 - {0} END, 1e-15))"
_IMPORTANCE = (
    f"{_GROWN}, {_MIXED}, {_evaluate('px', 'pm')}, pv AS (SELECT *, 1 / (1 + exp(-(a * m + b))) AS q FROM pm JOIN k{LEARNER.newton} USING (series_id, fold)), "
    f"im AS (SELECT series_id, fold, feature, sum(w * ({_LOSS.format('q')} - ({_LOSS.format('p')}))) / sum(w) AS importance FROM pv GROUP BY ALL)"
)


@register(f"{_IMPORTANCE} SELECT series_id, fold, feature, importance FROM im")
def ml_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    return learning.permutation_importance(_direction(spark, sf), FEATURES, repeats=2)


@register(f"{_IMPORTANCE} SELECT series_id, fold, string_split(feature, '_')[1] AS family, sum(importance) AS importance FROM im GROUP BY ALL")
def ml_importance_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return learning.importance_by_group(learning.permutation_importance(_direction(spark, sf), FEATURES, repeats=2), learning.KEY)


@register(f"WITH {_cases_sql(_DIRECTION)} SELECT series_id, fold, pos, part, y, w, u FROM c")
def ml_fold_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of all folds: events, purging, uniqueness and balanced weights."""
    return _direction(spark, sf).cases.select("series_id", "fold", "pos", "part", "y", "w", "u")
