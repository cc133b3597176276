"""Labels and sample weights: barriers, horizons, concurrency, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import series


def fixed_horizon(bars: DataFrame, horizon: int, threshold: float = 0.0) -> DataFrame:
    """Adds ret = ln(close in `horizon` bars / close) and label, its sign beyond the threshold."""
    r = F.ln(F.lead("close", horizon).over(series()) / F.col("close"))
    out = bars.withColumn("ret", r)
    return out.withColumn("label", F.when(F.col("ret").isNull(), None).when(F.abs("ret") > threshold, F.signum("ret")).otherwise(0.0))


def triple_barrier(bars: DataFrame, *, target: str, pt_mult: float, sl_mult: float, horizon: int, vertical_label: str = "sign") -> DataFrame:
    """One row per bar with a positive target: which barrier its next `horizon` bars touch first.

    Barriers are close * exp(+-mult * target). Fills are max(barrier, open) above and min(barrier, open)
    below. Where one bar touches both, the side that its open has passed is first, else it is
    'ambiguous' (label 0, filled at its close). Without a touch the bar `horizon` ahead ends it at its close.
    The look ahead is a bounded frame, so no self-join is needed.
    """
    ahead = series().rowsBetween(1, horizon)
    rows = bars.withColumn("t_idx", F.row_number().over(series()) - 1)
    rows = rows.withColumn("__path", F.collect_list(F.struct("t_idx", "open", "high", "low", "close")).over(ahead))
    rows = rows.filter(F.col(target) > 0).withColumns({"upper": F.col("close") * F.exp(pt_mult * F.col(target)), "lower": F.col("close") * F.exp(-sl_mult * F.col(target))})
    hit = F.filter("__path", lambda b: (b["high"] >= F.col("upper")) | (b["low"] <= F.col("lower")))
    rows = rows.withColumn("__hit", F.get(hit, F.lit(0))).withColumn("__end", F.get("__path", F.lit(horizon - 1)))
    h, up, down = F.col("__hit"), F.col("__hit.high") >= F.col("upper"), F.col("__hit.low") <= F.col("lower")
    kind = (
        F.when(h.isNotNull() & up & down & (h["open"] >= F.col("upper")), "pt")
        .when(h.isNotNull() & up & down & (h["open"] <= F.col("lower")), "sl")
        .when(h.isNotNull() & up & down, "ambiguous")
        .when(h.isNotNull() & up, "pt")
        .when(h.isNotNull(), "sl")
        .when(F.col("__end").isNotNull(), "vertical")
        .otherwise("incomplete")
    )
    rows = rows.withColumn("barrier_hit", kind)
    price = F.when(F.col("barrier_hit") == "pt", F.greatest("upper", h["open"])).when(F.col("barrier_hit") == "sl", F.least("lower", h["open"])).when(F.col("barrier_hit") == "ambiguous", h["close"]).otherwise(F.col("__end.close"))
    rows = rows.withColumn("exit_price", price).withColumn("ret", F.ln(F.col("exit_price") / F.col("close")))
    vertical = F.signum("ret") if vertical_label == "sign" else F.lit(0.0)
    label = F.when(F.col("barrier_hit") == "pt", 1.0).when(F.col("barrier_hit") == "sl", -1.0).when(F.col("barrier_hit") == "ambiguous", 0.0).when(F.col("barrier_hit") == "vertical", vertical)
    t1 = F.coalesce(h["t_idx"], F.col("__end.t_idx"))
    return rows.withColumn("label", label).withColumn("t1_idx", t1).select("series_id", F.col("time").alias("t_event"), "t_idx", "t1_idx", "barrier_hit", "exit_price", "ret", "label")


def meta_labels(labels: DataFrame, vertical: str = "sign") -> DataFrame:
    """1 for a profitable end, else 0."""
    by_end = F.when(F.col("barrier_hit") == "pt", 1).when(F.col("barrier_hit") == "sl", 0)
    return labels.withColumn("meta", by_end.when(F.col("barrier_hit") == "vertical", (F.col("ret") > 0).cast("int") if vertical == "sign" else F.lit(0)))


def concurrency(labels: DataFrame, n_bars: DataFrame) -> DataFrame:
    """How many labels cover each bar over (t_idx, t1_idx]; n_bars has (series_id, pos)."""
    done = labels.filter("t1_idx IS NOT NULL")
    steps = done.select("series_id", (F.col("t_idx") + 1).alias("pos"), F.lit(1).alias("d")).union(done.select("series_id", (F.col("t1_idx") + 1).alias("pos"), F.lit(-1).alias("d")))
    net = steps.groupBy("series_id", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return n_bars.join(net, ["series_id", "pos"], "left").select("series_id", "pos", F.sum(F.coalesce("d", F.lit(0))).over(w).alias("active"))


def uniqueness(labels: DataFrame, active: DataFrame) -> DataFrame:
    """The mean of 1 / concurrency over each label's span (1 for an empty span), by prefix sums."""
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = active.select("series_id", "pos", F.sum(F.when(F.col("active") > 0, 1 / F.col("active")).otherwise(0.0)).over(w).alias("s"))
    done = labels.filter("t1_idx IS NOT NULL")
    a = sums.select("series_id", F.col("pos").alias("t_idx"), F.col("s").alias("s0"))
    b = sums.select("series_id", F.col("pos").alias("t1_idx"), F.col("s").alias("s1"))
    mean = F.when(F.col("t1_idx") > F.col("t_idx"), (F.col("s1") - F.col("s0")) / (F.col("t1_idx") - F.col("t_idx"))).otherwise(1.0)
    return done.join(a, ["series_id", "t_idx"]).join(b, ["series_id", "t1_idx"]).withColumn("uniqueness", mean).drop("s0", "s1")


def return_weights(labels: DataFrame, active: DataFrame, returns: DataFrame, ret: str = "r") -> DataFrame:
    """labels with weight: |sum of return / concurrency over the span|, of mean 1 in each series, by prefix sums."""
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("active") > 0, F.coalesce(F.col(ret), F.lit(0.0)) / F.col("active")).otherwise(0.0)
    sums = active.join(returns.select("series_id", "pos", ret), ["series_id", "pos"]).select("series_id", "pos", F.sum(own).over(w).alias("s"))
    a = sums.select("series_id", F.col("pos").alias("t_idx"), F.col("s").alias("s0"))
    b = sums.select("series_id", F.col("pos").alias("t1_idx"), F.col("s").alias("s1"))
    done = labels.filter("t1_idx IS NOT NULL").join(a, ["series_id", "t_idx"]).join(b, ["series_id", "t1_idx"]).withColumn("__w", F.abs(F.col("s1") - F.col("s0")))
    return mean_one(done, "__w", "weight").drop("s0", "s1", "__w")


def mean_one(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the column divided by its mean in each series (unless that is 0)."""
    mean = F.avg(column).over(Window.partitionBy("series_id"))
    return rows.withColumn(out, F.when(mean > 0, F.col(column) / mean).otherwise(F.col(column)))


def decay_weights(rows: DataFrame, last: float, *, column: str = "uniqueness", order: str = "t_idx", out: str = "decay") -> DataFrame:
    """Linear decay over cumulative uniqueness: 1 for the newest, `last` for the oldest; below 0 that share of the oldest gets 0."""
    if not -1 < last <= 1:
        raise ValueError("last must be above -1 and at most 1")
    whole = Window.partitionBy("series_id")
    total = F.sum(column).over(whole)
    so_far = F.sum(column).over(whole.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    slope = (1 - last) / total if last >= 0 else 1 / ((last + 1) * total)
    return rows.withColumn(out, F.greatest(F.lit(0.0), 1 - slope * total + slope * so_far))


def label_ends(labels: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (series_id, pos) with label_end: the last bar of the labels that start there, else the bar itself."""
    ends = labels.groupBy("series_id", F.col("t_idx").alias("pos")).agg(F.max("t1_idx").alias("__e"))
    return positions.join(ends, ["series_id", "pos"], "left").withColumn("label_end", F.greatest(F.col("pos"), F.coalesce("__e", "pos"))).drop("__e")


def with_tail(rows: DataFrame, holding: int, pos: str = "pos") -> DataFrame:
    """rows with stays: whether a label of the longest holding time ends within the data."""
    last = F.max(pos).over(Window.partitionBy("series_id"))
    return rows.withColumn("stays", F.col(pos) <= last - holding)
