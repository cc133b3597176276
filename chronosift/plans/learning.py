"""Walk-forward learning on labelled events: the boosted trees of all series and folds grow together.

A case is one event of one (series, fold). Training cases carry a label whose last bar lies before the fold's end of training; the last
of them validate, and fitting cases whose labels reach into those are purged. Features become bins by the fitting cases'
own means and deviations. Each round finds the best splits of all folds by one histogram of (fold, node, feature, bin), so the
work is partial sums over cases and one small row a fold; no fold is a task of its own. Trees are stored round by round,
and a case's margin is read off the trees of its fold, so cases are written once and never changed.

Validation cases calibrate the margin, scale the forecast, and say whether it has any skill: an area under the curve
against its error with as many independent labels as are unique.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.scalars import clip, dead_zone, normal_cdf_of
from chronosift.operators import labels as lb
from chronosift.operators import splits
from chronosift.sources.store import Steps

KEY = ["series_id", "fold"]


@dataclass(frozen=True)
class Learner:
    """What training takes; bins are of half a deviation each."""

    rounds: int = 6
    depth: int = 2
    rate: float = 0.3
    l2: float = 1.0
    bins: int = 16
    least_weight: float = 1.0
    validate: float = 0.25
    embargo: int = 0
    balanced: bool = True
    newton: int = 6


def event_positions(rows: DataFrame, *, kind: str = "all", stride: int = 1, event: str = "event", side: str = "side") -> DataFrame:
    """The rows (series_id, pos, ..) that are events: all, those with a cusum event, or those where the side flips to another but 0;
    of these each stride-th of a series."""
    if kind == "cusum":
        rows = rows.filter(F.col(event) != 0)
    elif kind == "flip":
        before = F.lag(side, 1, 0.0).over(Window.partitionBy("series_id").orderBy("pos"))
        rows = rows.withColumn("__before", before).filter((F.col(side) != 0) & (F.col(side) != F.col("__before"))).drop("__before")
    elif kind != "all":
        raise ValueError(f"kind must be all, cusum or flip, not {kind!r}")
    if stride > 1:
        nth = F.row_number().over(Window.partitionBy("series_id").orderBy("pos")) - 1
        rows = rows.withColumn("__nth", nth).filter(F.col("__nth") % stride == 0).drop("__nth")
    return rows


def drop_columns(names: list[str], patterns: list[str]) -> list[str]:
    """The feature names that no pattern is found in."""
    import re

    return [n for n in names if not any(re.search(p, n) for p in patterns)]


def sample_weights(labels: DataFrame, bars: DataFrame, kind: str = "uniqueness", *, returns: DataFrame | None = None, last: float = 1.0) -> DataFrame:
    """labels (series_id, t_idx, t1_idx) with uniqueness and weight, of mean 1 in each series.

    kind is none, uniqueness, return_attribution or uniqueness_x_return (returns then has series_id, pos, r); last is the oldest label's share
    of a linear decay. bars has (series_id, pos). A series_id may be a struct, such as a series and its fold.
    """
    active = lb.concurrency(labels, bars)
    out = lb.uniqueness(labels, active)
    if kind not in ("none", "uniqueness", "return_attribution", "uniqueness_x_return"):
        raise ValueError(f"unknown kind of weight {kind!r}")
    w = F.lit(1.0) if kind == "none" else F.col("uniqueness")
    if "return" in kind:
        shares = lb.return_weights(labels, active, returns).select("series_id", "t_idx", F.col("weight").alias("__r"))
        out = out.join(shares, ["series_id", "t_idx"])
        w = F.col("__r") if kind == "return_attribution" else w * F.col("__r")
    if last < 1:
        out = lb.decay_weights(out, last, out="__decay")
        w = w * F.col("__decay")
    return lb.mean_one(out.withColumn("__w", F.coalesce(w, F.lit(0.0))), "__w", "weight").drop("__w", "__r", "__decay")


def fold_cases(rows: DataFrame, features: list[str], labels: DataFrame, folds: list[dict], learner: Learner, steps: Steps, *, weight: str = "uniqueness") -> DataFrame:
    """(series_id, fold, pos, part, y, w, u, x): fit, val and test cases of every fold.

    rows has (series_id, pos) and the features, of which a case needs all; labels has (series_id, t_idx, t1_idx, y), one an event. A test case is
    any row in the fold's test bars; its label isn't looked at. The few folds are broadcast.
    """
    spans = F.broadcast(splits.folds_frame(rows.sparkSession, folds))
    p = F.col("pos")
    whole = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in features])
    ready = rows.filter(whole).select("series_id", "pos", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    tests = ready.join(spans, (p >= F.col("test_from")) & (p < F.col("test_to"))).select(*KEY, "pos", F.lit("test").alias("part"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("u"), "x")

    t = F.col("t_idx")
    known = labels.filter("y IS NOT NULL AND t1_idx IS NOT NULL").join(ready.withColumnRenamed("pos", "t_idx"), ["series_id", "t_idx"])
    train = known.join(spans, (t >= F.col("train_from")) & (t < F.col("train_to")) & (F.col("t1_idx") < F.col("train_to"))).select(F.struct(*KEY).alias("series_id"), "t_idx", "t1_idx", "y", "x")
    # bars of a fold's training span, for its own labels' concurrency
    bars = rows.select("series_id", "pos").join(spans, (p >= F.col("train_from")) & (p < F.col("train_to"))).select(F.struct(*KEY).alias("series_id"), "pos")
    weighed = sample_weights(steps.put(train, "labels"), bars, weight).select("series_id.*", "t_idx", "t1_idx", "y", "x", "uniqueness", "weight")
    own = Window.partitionBy(*KEY)
    nth = weighed.withColumn("__n", F.count(F.lit(1)).over(own)).withColumn("__back", F.row_number().over(own.orderBy(F.desc("t_idx"))))
    tail = F.col("__back") <= F.ceil(F.col("__n") * learner.validate)
    cut = nth.withColumn("__val", tail).withColumn("__first", F.min(F.when(F.col("__val"), F.col("t_idx"))).over(own))
    part = F.when(F.col("__val"), "val").when(F.col("t1_idx") + learner.embargo < F.col("__first"), "fit")
    cases = cut.select(*KEY, F.col("t_idx").alias("pos"), part.alias("part"), "y", F.col("weight").alias("w"), F.col("uniqueness").alias("u"), "x").filter("part IS NOT NULL")
    return cases.unionByName(tests)


def binned(cases: DataFrame, features: int, learner: Learner) -> DataFrame:
    """cases with bins of the features in place of x, by means and deviations of the fitting cases, and balanced weights."""
    fit = F.col("part") == "fit"
    x = [F.when(fit, F.col("x")[i]) for i in range(features)]
    stats = cases.groupBy(*KEY).agg(
        F.array(*[F.avg(v) for v in x]).alias("__m"), F.array(*[F.stddev_pop(v) for v in x]).alias("__s"),
        F.sum(F.when(fit & (F.col("y") > 0), F.col("w"))).alias("__up"), F.sum(F.when(fit & (F.col("y") <= 0), F.col("w"))).alias("__down"),
    ).filter("__up > 0 AND __down > 0")
    half = learner.bins // 2

    def place(v: Column, i: Column) -> Column:
        z = F.when(F.col("__s")[i] > 0, (v - F.col("__m")[i]) / F.col("__s")[i]).otherwise(0.0)
        return (F.greatest(F.least(F.floor(2 * z), F.lit(half - 1)), F.lit(-half)) + half).cast("int")

    even = (F.col("__up") + F.col("__down")) / 2 / F.when(F.col("y") > 0, F.col("__up")).otherwise(F.col("__down"))
    w = F.when(fit, F.col("w") * even).otherwise(F.col("w")) if learner.balanced else F.col("w")
    rows = cases.join(stats, KEY)
    return rows.select(*KEY, "pos", "part", "y", w.alias("w"), "u", F.transform("x", place).alias("bins"))


def leaf(bins: Column, tree: Column, depth: int) -> Column:
    """The value that a tree (splits by node from 1, values by leaf) gives to bins."""
    node = F.lit(1)
    for _ in range(depth):
        cut = tree["cuts"][node]
        node = 2 * node + F.when(cut.isNotNull() & (F.get(bins, cut["feature"]) > cut["bin"]), 1).otherwise(0)
    return F.coalesce(tree["values"][node], F.lit(0.0))


def margin(bins: Column, trees: Column, depth: int) -> Column:
    return F.aggregate(F.coalesce(trees, F.array().cast(_TREES)), F.lit(0.0), lambda s, t: s + leaf(bins, t, depth))


_TREES = "array<struct<round:int,cuts:map<int,struct<feature:int,bin:int>>,values:map<int,double>>>"


def _best_splits(rows: DataFrame, learner: Learner) -> DataFrame:
    """(key, node, feature, bin) of the best split of each node that has one; rows have node, g, h and bins."""
    each = rows.select(*KEY, "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    sums = each.groupBy(*KEY, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    all_ = Window.partitionBy(*KEY, "node", "feature")
    upto = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "gt": F.sum("g").over(all_), "ht": F.sum("h").over(all_)})
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    part = lambda g, h: g * g / (h + learner.l2)
    gain = F.round(part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("gt"), F.col("ht")), 9)
    able = cut.withColumn("gain", gain).filter((F.col("hl") >= learner.least_weight) & (hr >= learner.least_weight) & (F.col("gain") > 0))
    best = F.row_number().over(Window.partitionBy(*KEY, "node").orderBy(F.desc("gain"), "feature", "bin"))
    return able.withColumn("__best", best).filter("__best = 1").select(*KEY, "node", "feature", "bin")


def _map(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """One row a key: a map from its nodes, of which a tree has 2^depth at most, to the value."""
    return rows.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("node", value))).alias(name))


def grow(cases: DataFrame, learner: Learner, steps: Steps) -> DataFrame:
    """(series_id, fold, trees): the trees of every fold, from its fitting cases."""
    trees = None
    for number in range(learner.rounds):
        rows = cases.filter("part = 'fit'")
        if trees is None:
            rows = rows.withColumn("m", F.lit(0.0))
        else:
            rows = rows.join(trees, KEY, "left").withColumn("m", margin(F.col("bins"), F.col("trees"), learner.depth)).drop("trees")
        p = 1 / (1 + F.exp(-F.col("m")))
        rows = rows.select(*KEY, "bins", F.lit(1).alias("node"), (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        found = None
        for _ in range(learner.depth):
            # written, so that neither the next level nor the leaves work out a level again
            best = steps.put(_best_splits(rows, learner), "splits")
            found = best if found is None else found.unionByName(best)
            at = _map(best, F.struct("feature", "bin"), "__cuts")
            cut = F.col("__cuts")[F.col("node")]
            right = F.when(cut.isNotNull() & (F.get("bins", cut["feature"]) > cut["bin"]), 1).otherwise(0)
            rows = rows.join(at, KEY, "left").withColumn("node", 2 * F.col("node") + right).drop("__cuts")
        leaves = rows.groupBy(*KEY, "node").agg((-learner.rate * F.sum("g") / (F.sum("h") + learner.l2)).alias("value"))
        made = _map(leaves, F.col("value"), "values").join(_map(found, F.struct("feature", "bin"), "cuts"), KEY, "left")
        tree = made.select(*KEY, F.struct(F.lit(number).alias("round"), "cuts", "values").alias("tree"))
        every = tree.select(*KEY, F.array("tree").alias("trees")) if trees is None else trees.join(tree, KEY).select(*KEY, F.array_append("trees", F.col("tree")).alias("trees"))
        trees = steps.put(every, "trees", keep=number == learner.rounds - 1)
    return trees


def calibration(scored: DataFrame, rounds: int) -> DataFrame:
    """(key, a, b) of sigmoid(a m + b) on the validation cases by Newton's method, targets and curvature softened."""
    held = scored.filter("part = 'val'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "m", "y", "w"))).alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x))
    held = held.withColumn("__up", total(lambda x: F.when(x["y"] > 0, 1.0).otherwise(0.0))).withColumn("__down", F.size("v") - F.col("__up"))
    held = held.withColumns({"a": F.lit(1.0), "b": F.lit(0.0)})
    goal = lambda x: F.when(x["y"] > 0, (F.col("__up") + 1) / (F.col("__up") + 2)).otherwise(1 / (F.col("__down") + 2))
    for _ in range(rounds):
        p = lambda x: 1 / (1 + F.exp(-(F.col("a") * x["m"] + F.col("b"))))
        gap, bend = lambda x: x["w"] * (p(x) - goal(x)), lambda x: x["w"] * p(x) * (1 - p(x))
        sums = {"ga": lambda x: gap(x) * x["m"], "gb": gap, "aa": lambda x: bend(x) * x["m"] * x["m"], "ab": lambda x: bend(x) * x["m"], "bb": bend}
        held = held.withColumns({f"__{k}": total(f) + (1e-3 if k in ("aa", "bb") else 0.0) for k, f in sums.items()})
        det = F.col("__aa") * F.col("__bb") - F.col("__ab") * F.col("__ab")
        held = held.withColumns({"a": F.col("a") - (F.col("__bb") * F.col("__ga") - F.col("__ab") * F.col("__gb")) / det, "b": F.col("b") - (F.col("__aa") * F.col("__gb") - F.col("__ab") * F.col("__ga")) / det})
    return held.select(*KEY, "a", "b")


def grouped_auc(rows: DataFrame, keys: list[str], score: str = "p", y: str = "y", weight: str = "w") -> DataFrame:
    """(keys, auc): weighted, ties count half. Cases are summed by score first, so a window sees one row a (keys, score)."""
    w = F.col(weight)
    by = rows.groupBy(*keys, F.col(score).alias("__s")).agg(F.sum(F.when(F.col(y) > 0, w).otherwise(0.0)).alias("up"), F.sum(F.when(F.col(y) > 0, 0.0).otherwise(w)).alias("down"))
    below = F.coalesce(F.sum("down").over(Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return by.withColumn("__b", below).groupBy(*keys).agg(F.try_divide(F.sum(F.col("up") * (F.col("__b") + F.col("down") / 2)), F.sum("up") * F.sum("down")).alias("auc"))


def skill_gate(scored: DataFrame, least: float | None = 1.0) -> DataFrame:
    """(key, n_val, n_eff, auc, se, z, passed): the validation cases' area under the curve against chance.

    n_eff is the sum of their labels' uniqueness; without cases of both kinds z is null and the gate stays shut, unless least is None.
    """
    val = scored.filter("part = 'val'")
    n = val.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_val"), F.sum("u").alias("n_eff"), F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("__up"))
    rows = n.join(grouped_auc(val, KEY), KEY)
    se = F.sqrt(F.try_divide(F.col("n_eff") + 1, 12 * F.col("__up") * (1 - F.col("__up")) * F.col("n_eff") * F.col("n_eff")))
    z = F.try_divide(F.col("auc") - 0.5, F.col("se"))
    out = rows.withColumn("se", se).withColumn("z", z)
    passed = F.lit(True) if least is None else F.coalesce(F.col("z") >= least, F.lit(False))
    return out.select(*KEY, "n_val", "n_eff", "auc", "se", "z", passed.alias("passed"))


@dataclass
class Fitted:
    """The binned cases with margin m and calibrated p, the trees, and what calibrates them."""

    cases: DataFrame
    trees: DataFrame
    scale: DataFrame
    learner: Learner


def fit_folds(cases: DataFrame, features: int, learner: Learner, steps: Steps) -> Fitted:
    """Trains every fold; folds without fitting cases of both kinds, or without validation cases, give nothing."""
    ready = steps.put(binned(cases, features, learner), "cases")
    trees = grow(ready, learner, steps)
    scored = ready.join(trees, KEY).withColumn("m", margin(F.col("bins"), F.col("trees"), learner.depth)).drop("trees")
    scale = steps.put(calibration(scored, learner.newton), "calibration", keep=True)
    p = 1 / (1 + F.exp(-(F.col("a") * F.col("m") + F.col("b"))))
    out = Fitted(steps.put(scored.join(scale, KEY).withColumn("p", p).drop("a", "b"), "scored", keep=True), trees, scale, learner)
    steps.clear()
    return out


def forecast(fitted: Fitted, raw: Callable[[Column], Column], *, least: float | None = 1.0, target: float = 0.5, most: float = 10.0) -> DataFrame:
    """(key, pos, p, scalar, forecast) of the test cases.

    raw turns a probability into a forecast; the validation cases' mean size scales it to the target, 0 where the gate is shut.
    """
    size = F.abs(raw(F.col("p")))
    mean = fitted.cases.filter("part = 'val'").groupBy(*KEY).agg(F.avg(size).alias("__mean"))
    gate = skill_gate(fitted.cases, least).select(*KEY, "passed")
    scalar = F.when(F.col("passed") & (F.col("__mean") > 0), F.least(target / F.col("__mean"), F.lit(most))).otherwise(0.0)
    by_fold = mean.join(gate, KEY).select(*KEY, scalar.alias("scalar"))
    tests = fitted.cases.filter("part = 'test'").join(by_fold, KEY)
    return tests.select(*KEY, "pos", "p", "scalar", clip(F.col("scalar") * raw(F.col("p")), -1.0, 1.0).alias("forecast"))


def direction(p: Column, dead: float = 0.02) -> Column:
    """A probability of rising as a forecast."""
    return dead_zone(2 * p - 1, dead)


def bet(p: Column, threshold: float = 0.5) -> Column:
    """The size of a bet that succeeds with probability p: none below the threshold."""
    z = F.try_divide(p - 0.5, F.sqrt(p * (1 - p)))
    return F.when(p >= threshold, F.greatest(2 * normal_cdf_of(z) - 1, F.lit(0.0))).otherwise(0.0)


def stepped(size: Column, step: float) -> Column:
    """A size on a grid of steps; 0 leaves it."""
    return F.round(size / step) * step if step > 0 else size


def permutation_importance(fitted: Fitted, features: list[str], repeats: int = 3) -> DataFrame:
    """(key, feature, importance): how much the validation loss grows when a feature's values change places.

    For each feature and repeat the cases of a fold are ordered by a hash of their position and take the bin of the case
    with that rank by position; one plan for all features, repeats and folds.
    """
    val = fitted.cases.filter("part = 'val'").select(*KEY, "pos", "y", "w", "bins", "p")
    own = Window.partitionBy(*KEY, "feature", "repeat")
    names = F.array(*[F.lit(n) for n in features])
    each = val.select("*", F.posexplode(names).alias("at", "feature")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seed = F.md5(F.concat_ws("|", F.col("pos").cast("string"), "feature", F.col("repeat").cast("string")))
    ranked = each.withColumns({"rank": F.row_number().over(own.orderBy("pos")), "drawn": F.row_number().over(own.orderBy(seed, "pos"))})
    given = ranked.select(*KEY, "feature", "repeat", F.col("drawn").alias("rank"), F.get("bins", F.col("at")).alias("__new"))
    mixed = ranked.join(given, [*KEY, "feature", "repeat", "rank"]).withColumn("bins", F.transform("bins", lambda b, i: F.when(i == F.col("at"), F.col("__new")).otherwise(b)))
    again = mixed.join(fitted.trees, KEY).join(fitted.scale, KEY)
    q = 1 / (1 + F.exp(-(F.col("a") * margin(F.col("bins"), F.col("trees"), fitted.learner.depth) + F.col("b"))))
    loss = lambda p: -F.when(F.col("y") > 0, F.ln(F.greatest(p, F.lit(1e-15)))).otherwise(F.ln(F.greatest(1 - p, F.lit(1e-15))))
    return again.groupBy(*KEY, "feature").agg((F.sum(F.col("w") * (loss(q) - loss(F.col("p")))) / F.sum("w")).alias("importance"))


def importance_by_group(importance: DataFrame, keys: list[str]) -> DataFrame:
    """Importances summed by family, which is a feature's name before its first underscore."""
    return importance.groupBy(*keys, F.substring_index("feature", "_", 1).alias("family")).agg(F.sum("importance").alias("importance"))


def mean_importance(importance: DataFrame) -> DataFrame:
    """(feature, importance, folds): over all series and folds, the greatest first."""
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("folds")).orderBy(F.desc("importance"), "feature")


def sided_labels(bars: DataFrame, side: str, *, target: str, pt_mult: float, sl_mult: float, horizon: int) -> DataFrame:
    """Barrier labels of a bet on a side: (series_id, t_idx, t1_idx, y), 1 for a bet that ended with a profit.

    Profit lies below for a short side; ambiguous and unfinished bets have no label.
    """
    sides = bars.select("series_id", F.col("time").alias("t_event"), F.col(side).alias("__side")).filter(F.col("__side") != 0)
    up = lb.triple_barrier(bars, target=target, pt_mult=pt_mult, sl_mult=sl_mult, horizon=horizon)
    down = up if math.isclose(pt_mult, sl_mult) else lb.triple_barrier(bars, target=target, pt_mult=sl_mult, sl_mult=pt_mult, horizon=horizon)
    joined = lambda found, sign: found.join(sides.filter(F.col("__side") * sign > 0), ["series_id", "t_event"])
    both = joined(up, 1).unionByName(joined(down, -1))
    y = F.when(F.col("label") != 0, (F.col("label") * F.col("__side") > 0).cast("double"))
    return both.select("series_id", "t_idx", "t1_idx", y.alias("y"))
