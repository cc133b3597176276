"""References of feature distributions, drift against them, and bands of a running account.

A reference has, for each column, the edges of its bins and the share of the training rows in each. All columns are
summed up in passes over one unpivoted frame: quantile summaries that merge, which bracket each edge; counts of what lies
below and within the brackets, which give the exact quantiles; then counts of bins. What reaches the driver is a row a
(column, bin), however many rows there are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.functions.scalars import normal_quantile

WARN, ALERT, FLOOR = 0.1, 0.25, 1e-4


def unpivoted(rows: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, value) of all finite values."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    each = rows.select(*keys, F.explode(F.array(*pairs)).alias("v")).select(*keys, "v.column", "v.value")
    return each.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


@dataclass(frozen=True)
class Reference:
    """Edges and expected shares by column; a value's bin is the number of edges at most as large."""

    edges: dict[str, list[float]]
    expected: dict[str, list[float]]
    rows: int = 0
    source: str = "train"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(column, edges, expected), a row a column."""
        rows = [(c, self.edges[c], self.expected[c]) for c in self.edges]
        return spark.createDataFrame(rows, "column string, edges array<double>, expected array<double>")

    def missing(self, rows: DataFrame) -> list[str]:
        return sorted(c for c in self.edges if c not in rows.columns)

    def to_json(self) -> str:
        return json.dumps({"edges": self.edges, "expected": self.expected, "rows": self.rows, "source": self.source})

    @classmethod
    def from_json(cls, said: str) -> Reference:
        return cls(**json.loads(said))


def _bins(spark: SparkSession, edges: dict[str, list[float]]) -> DataFrame:
    """(column, edges) to be broadcast: a row a column."""
    return F.broadcast(spark.createDataFrame(list(edges.items()), "column string, edges array<double>"))


def _place(value: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def _summaries(long: DataFrame, fractions: list[float], accuracy: int, *more: Column) -> list:
    """A row a column with its quantiles q, each within rows / accuracy ranks."""
    asked = F.array(*[F.lit(x) for x in fractions])
    return long.groupBy("column").agg(F.percentile_approx("value", asked, accuracy).alias("q"), *more).collect()


def _around(bins: int, reach: float) -> list[float]:
    """Fractions that lie by reach below and above each of the quantiles."""
    return [max(0.0, min(1.0, i / bins + d)) for d in (-reach, reach) for i in range(1, bins)]


def _ranked(long: DataFrame, ranks: dict[str, list[int]], brackets: dict[str, list[float]]) -> dict[tuple[str, int], float]:
    """(column, i) to the value of the i-th rank (from 1), for those within their bracket; brackets are all low ends, then all high ends, ascending.

    Values within a bracket are summed up by value, others by the brackets that they lie between.
    """
    spark = long.sparkSession
    table = spark.createDataFrame([(c, q[: len(q) // 2], q[len(q) // 2 :]) for c, q in brackets.items()], "column string, lows array<double>, highs array<double>")
    begun = F.size(F.filter("lows", lambda e: e <= F.col("value")))
    ended = F.size(F.filter("highs", lambda e: e < F.col("value")))
    marked = long.join(F.broadcast(table), "column").select("column", begun.alias("begun"), ended.alias("ended"), "value")
    counts = marked.groupBy("column", "begun", "ended", F.when(F.col("begun") > F.col("ended"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.broadcast(spark.createDataFrame([(c, i, k) for c, own in ranks.items() for i, k in enumerate(own)], "column string, i int, rank long"))
    below = counts.groupBy("column", "begun").agg(F.sum("n").alias("n")).join(wanted, "column").groupBy("column", "i").agg(F.coalesce(F.sum(F.when(F.col("begun") <= F.col("i"), F.col("n"))), F.lit(0)).alias("below"))
    inside = counts.filter("begun > ended").withColumn("i", F.explode(F.sequence(F.col("ended"), F.col("begun") - 1)))
    upto = F.sum("n").over(Window.partitionBy("column", "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    # brackets may overlap: a value counts once in each
    totals = inside.groupBy("column", "i", "value").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    placed = totals.join(wanted, ["column", "i"]).join(F.broadcast(below), ["column", "i"])
    hit = placed.filter((F.col("below") + F.col("upto") >= F.col("rank")) & (F.col("below") + F.col("upto") - F.col("n") < F.col("rank")))
    return {(r["column"], r["i"]): r["value"] for r in hit.select("column", "i", "value").collect()}


def reference(rows: DataFrame, columns: list[str], *, bins: int = 10, least: int = 50, accuracy: int = 100_000) -> Reference:
    """The reference of rows: bins between quantiles, or one a value for columns of at most `bins` values.

    Quantiles are exact: of n values, those at the ranks n i / bins, rounded up. accuracy only says how narrowly they are looked for.
    Columns with fewer than `least` values, or with a single one, are left out.
    """
    spark = rows.sparkSession
    long = unpivoted(rows, columns)
    reach = 2 / accuracy
    found = _summaries(long, _around(bins, reach), accuracy, F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.approx_count_distinct("value").alias("values"))
    found = {r["column"]: r for r in found if r["n"] >= least and r["low"] < r["high"]}
    # an estimate below four times as many stands for few values without doubt
    few = [c for c, r in found.items() if r["values"] <= 4 * bins]
    values = {r["column"]: r["values"] for r in long.filter(F.col("column").isin(few)).groupBy("column").agg(F.sort_array(F.collect_set("value")).alias("values")).collect()} if few else {}
    many = [c for c in found if not 2 <= len(values.get(c, [])) <= bins]
    ranks = {c: [-(-found[c]["n"] * i // bins) for i in range(1, bins)] for c in many}
    brackets, exact = {c: list(found[c]["q"]) for c in many}, {}
    while brackets:
        exact |= _ranked(long, {c: ranks[c] for c in brackets}, brackets)
        left = [c for c in brackets if any((c, i) not in exact for i in range(bins - 1))]
        # a summary that was further off than it says: look more widely, in the end everywhere
        reach *= 16
        brackets = {r["column"]: list(r["q"]) for r in _summaries(long.filter(F.col("column").isin(left)), _around(bins, reach), accuracy)} if left else {}
        if reach > 1:
            brackets = {c: [found[c]["low"]] * (bins - 1) + [found[c]["high"]] * (bins - 1) for c in left}
    edges = {}
    for c in columns:
        if c in found:
            own = values.get(c, [])
            edges[c] = sorted({exact[c, i] for i in range(bins - 1)}) if c in many else [(a + b) / 2 for a, b in zip(own, own[1:], strict=False)]
    if not edges:
        return Reference({}, {}, 0)
    placed = long.join(_bins(spark, edges), "column").groupBy("column", _place(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["column"], r["bin"]): r["n"] for r in placed.collect()}
    expected = {c: [counts.get((c, b), 0) / found[c]["n"] for b in range(len(e) + 1)] for c, e in edges.items()}
    return Reference(edges, expected, max(found[c]["n"] for c in edges))


def gaussian_reference(columns: list[str], bins: int = 10) -> Reference:
    """Bins of equal probability of a standard normal, for columns that a scaler has brought to that."""
    edges = [normal_quantile(i / bins) for i in range(1, bins)]
    return Reference({c: list(edges) for c in columns}, {c: [1.0 / bins] * bins for c in columns}, 0, "gaussian")


def _shares(counts: Column) -> Column:
    """Shares, none below FLOOR, that add up to 1."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    raised = F.transform(counts, lambda x: F.greatest(x / total, F.lit(FLOOR)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def drift(known: Reference, rows: DataFrame, keys: list[str] = (), *, warn: float = WARN, alert: float = ALERT, least: int = 100) -> DataFrame:
    """(keys, column, n, psi, level) of every column of the reference that rows have, in each group of keys.

    Groups with fewer than `least` values of a column have level 'few' and no psi.
    """
    spark, here = rows.sparkSession, [c for c in known.edges if c in rows.columns]
    if not here:
        kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
        return spark.createDataFrame([], f"{kinds + ', ' if kinds else ''}column string, n long, psi double, level string")
    table = F.broadcast(known.frame(spark))
    placed = unpivoted(rows, here, list(keys)).join(table, "column").groupBy(*keys, "column", _place(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = placed.groupBy(*keys, "column").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("of")).join(table, "column")
    actual = F.transform("expected", lambda _, i: F.coalesce(F.element_at("of", i), F.lit(0)).cast("double"))
    both = F.zip_with(_shares(F.col("expected")), _shares(actual), lambda e, a: (a - e) * F.ln(a / e))
    psi = F.when(F.col("n") >= least, F.aggregate(both, F.lit(0.0), lambda s, x: s + x))
    out = counts.select(*keys, "column", "n", psi.alias("psi"))
    return out.withColumn("level", F.when(F.col("psi").isNull(), "few").when(F.col("psi") >= alert, "alert").when(F.col("psi") >= warn, "warn").otherwise("ok"))


def top(drifts: DataFrame, k: int = 5, keys: list[str] = ()) -> DataFrame:
    """The k columns of each group that have drifted most, with their place from 1."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("psi"), "column")
    return drifts.filter("psi IS NOT NULL").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def drift_report(drifts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, columns, max_psi, n_warn, n_alert, alerts): a row a group; alerts lists its columns in order."""
    level = lambda x: F.col("level") == x
    return drifts.groupBy(*keys).agg(
        F.count("psi").alias("columns"), F.max("psi").alias("max_psi"), F.count_if(level("warn")).alias("n_warn"), F.count_if(level("alert")).alias("n_alert"),
        F.array_join(F.sort_array(F.collect_list(F.when(level("alert"), F.col("column")))), ",").alias("alerts"),
    )


def band_of(stats: Mapping | None, days: float = 252.0) -> tuple[float, float] | None:
    """(mean, deviation) of daily log returns: as given, or from a yearly Sharpe ratio and volatility, there or under 'combined'."""
    stats = stats or {}
    mean, sd = stats.get("daily_mean"), stats.get("daily_std")
    if mean is None or sd is None:
        nested = stats.get("combined")
        from_ = stats if stats.get("sharpe") is not None and stats.get("ann_vol") is not None else nested if isinstance(nested, Mapping) else {}
        try:
            ratio, vol = float(from_["sharpe"]), float(from_["ann_vol"])
        except (KeyError, TypeError, ValueError):
            return None
        sd = vol / math.sqrt(days)
        mean = ratio * vol / days - sd * sd / 2
    return (float(mean), float(sd)) if math.isfinite(mean) and math.isfinite(sd) and sd > 0 else None


def account_band(equity: DataFrame, keys: list[str], band: tuple[float, float], *, warn: float = -2.0, alert: float = -3.0, least: int = 5, time: str = "time", value: str = "equity") -> DataFrame:
    """(keys, day, n_days, cum, expected, z, low, high, level) after each day of each account.

    cum is the log return since the account's first value; days end with their last value, weekends count to Monday. Values
    that aren't positive are no values.
    """
    if not alert <= warn < 0:
        raise ValueError("need alert <= warn < 0")
    mean, sd = band
    good = equity.filter((F.col(value) > 0) & ~F.isnan(value) & (F.col(value) < float("inf")))
    own = Window.partitionBy(*keys)
    date = F.to_date(time)
    day = F.when(F.weekday(date) >= 5, F.next_day(date, "Mon")).otherwise(date)
    ends = good.groupBy(*keys, day.alias("day")).agg(F.max_by(value, time).alias("close"), F.min_by(value, time).alias("open"))
    rows = ends.withColumns({"n_days": (F.row_number().over(own.orderBy("day")) - 1).cast("long"), "first": F.first("open").over(own.orderBy("day"))})
    n = F.col("n_days")
    spread = sd * F.sqrt(n.cast("double"))
    rows = rows.withColumn("cum", F.ln(F.col("close") / F.col("first"))).withColumn("expected", n * mean)
    rows = rows.withColumns({"z": F.try_divide(F.col("cum") - F.col("expected"), spread), "low": F.when(n > 0, F.col("expected") + alert * spread), "high": F.when(n > 0, F.col("expected") - alert * spread)})
    level = F.when((n < least) | F.col("z").isNull(), "ok").when(F.col("z") <= alert, "critical").when(F.col("z") <= warn, "warning").otherwise("ok")
    return rows.select(*keys, "day", "n_days", "cum", "expected", "z", "low", "high", level.alias("level"))
