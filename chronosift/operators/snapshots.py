"""What a desk could know at a moment: point-in-time snapshots, journals with torn lines, and sums of usage.

A snapshot is one row a moment. Each source is joined as of the moment on its own availability: the newest finished bar with statistics of its
look-back, the newest published value of every macro series, events that are scheduled ahead (their names alone) and those just past (with
outcomes). To hide when it was, dates move by whole weeks and prices are told in units of the newest close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators.asof import asof_join
from chronosift.operators.intervals import counts_within
from chronosift.operators.rolling import series


def bar_statistics(bars: DataFrame, returns: tuple[int, ...] = (1, 5, 20), means: tuple[int, ...] = (50, 200), recent: int = 12) -> DataFrame:
    """bars with ret_n, from_mean_n (null until there are n bars) and the newest bars as an array of (time, close), oldest first."""
    w = series()
    new: dict[str, Column] = {f"ret_{n}": F.col("close") / F.lag("close", n).over(w) - 1 for n in returns}
    for n in means:
        full = w.rowsBetween(-(n - 1), 0)
        new[f"from_mean_{n}"] = F.when(F.count("close").over(full) == n, F.col("close") / F.avg("close").over(full) - 1)
    return bars.withColumns(new).withColumn("recent", F.collect_list(F.struct("time", "close")).over(w.rowsBetween(-(recent - 1), 0)))


def shift_days(first: str, epoch: str = "2101-01-03") -> int:
    """Whole weeks from a day to a made-up epoch, so that weekdays stay."""
    import datetime as dt

    return (dt.date.fromisoformat(epoch) - dt.date.fromisoformat(first)).days // 7 * 7


def snapshots(moments: DataFrame, bars: DataFrame, *, macro: DataFrame | None = None, events: DataFrame | None = None, now: str = "now", ahead_hours: float = 72.0, back_hours: float = 24.0, shift: int | None = None, listed: bool = True) -> DataFrame:
    """moments (now, ..) with the columns of bar_statistics (`bar_time`, `close`, ..), `macro` (name to value), `upcoming`, `past`.

    bars come from bar_statistics and are of one series; macro has (name, value, available_at); events have (time, name, and optionally surprise). A moment
    before the first finished bar has null columns. listed: False where a moment may have very many events; instead of their lists there are
    `n_upcoming`, `n_past`, `next_time` and `last_time`, without meeting events one by one. shift: days by which dates are moved, whole weeks; prices are then divided by the close.
    """
    if shift is not None and shift % 7:
        raise ValueError("dates move by whole weeks, so that weekdays stay")
    if events is not None and not listed:
        moments = _with_event_counts(moments, events, now, ahead_hours, back_hours)
    told = [c for c in bars.columns if c not in ("series_id", "available_at", "volume", "spread", "open", "high", "low") and c not in moments.columns]
    known = bars.select(*[F.col(c).alias("bar_time" if c == "time" else c) for c in told], "available_at")
    out = asof_join(moments, known, left_time=now, right_time="available_at", columns=["bar_time" if c == "time" else c for c in told])
    if macro is not None:
        out = _with_macro(out, macro, now)
    if events is not None and listed:
        out = _with_events(out, events, now, ahead_hours, back_hours)
    if shift is None:
        return out
    moved = lambda c: c + F.make_dt_interval(F.lit(shift))
    out = out.withColumn("recent", F.transform("recent", lambda b: F.struct(moved(b["time"]).alias("time"), (b["close"] / F.col("close")).alias("close"))))
    event = {"upcoming": lambda e: F.struct(moved(e["time"]).alias("time"), e["name"].alias("name")), "past": lambda e: F.struct(moved(e["time"]).alias("time"), e["name"].alias("name"), e["surprise"].alias("surprise"))}
    out = out.withColumns({c: F.transform(c, f) for c, f in event.items() if c in out.columns} if listed else {c: moved(F.col(c)) for c in ("next_time", "last_time") if events is not None})
    return out.withColumns({"close": F.when(F.col("close").isNotNull(), F.lit(1.0)), "bar_time": moved(F.col("bar_time")), now: moved(F.col(now))})


def _with_event_counts(rows: DataFrame, events: DataFrame, now: str, ahead: float, back: float) -> DataFrame:
    """How many events are ahead and past, the next of those and the last of these: running counts and as-of joins over distinct times."""
    us = lambda hours: round(hours * 3_600_000_000)
    at = events.filter("time IS NOT NULL").select("time").distinct()
    times = rows.select(now).filter(F.col(now).isNotNull()).distinct()
    found = counts_within(times, events, {"n_upcoming": (1, us(ahead) + 1), "n_past": (-us(back), 1)}, time=now)
    found = asof_join(found, at.select(F.col("time").alias("next_time")), left_time=now, right_time="next_time", columns=["next_time"], forward=True, strict=True, tolerance=f"{us(ahead)} microseconds")
    found = asof_join(found, at.select(F.col("time").alias("last_time")), left_time=now, right_time="last_time", columns=["last_time"], tolerance=f"{us(back)} microseconds")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = rows.join(found.withColumnRenamed(now, "__now"), F.col(now) == F.col("__now"), "left")
    return joined.select(*rows.columns, none("n_upcoming"), none("n_past"), "next_time", "last_time")


def _with_macro(rows: DataFrame, macro: DataFrame, now: str) -> DataFrame:
    """The values that have been published by each moment: a map that each publication of a series brings up to date.

    A running map over publications has an entry a series, however long the history; moments join the newest one.
    """
    # of each publication the newest row of every series by then, in slices of a month carried on by a window over months
    names = [r["name"] for r in macro.select("name").distinct().orderBy("name").limit(1000).collect()]
    w = Window.partitionBy(F.lit(0)).orderBy("available_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_time = macro.groupBy("available_at").agg(*[F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("date"))).alias(f"__m{i}") for i, n in enumerate(names)])
    filled = by_time.select("available_at", *[F.last(f"__m{i}", ignorenulls=True).over(w).alias(f"__m{i}") for i in range(len(names))])
    pairs = [F.struct(F.lit(n).alias("k"), F.col(f"__m{i}").alias("v")) for i, n in enumerate(names)]
    maps = filled.select(F.col("available_at").alias("__at"), F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())).alias("macro"))
    return asof_join(rows, maps, left_time=now, right_time="__at", columns=["macro"])


def _with_events(rows: DataFrame, events: DataFrame, now: str, ahead: float, back: float) -> DataFrame:
    """Arrays of the events ahead and of those past, met on days, so that no moment is held against all events."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    moments = rows.select(F.col(now).alias("__now")).filter("__now IS NOT NULL").distinct()
    listed = moments.withColumn("__day", F.explode(F.sequence(F.floor((seconds(F.col("__now")) - back * 3600) / 86400), F.floor((seconds(F.col("__now")) + ahead * 3600) / 86400))))
    surprise = F.col("surprise").cast("double") if "surprise" in events.columns else F.lit(None).cast("double")
    e = events.select("time", "name", surprise.alias("surprise")).withColumn("__day", F.floor(seconds(F.col("time")) / 86400))
    gap = seconds(F.col("time")) - seconds(F.col("__now"))
    near = listed.join(e, "__day").filter((gap <= ahead * 3600) & (gap >= -back * 3600))
    later = gap > 0
    lists = near.groupBy("__now").agg(
        F.sort_array(F.collect_list(F.when(later, F.struct("time", "name")))).alias("upcoming"),
        F.sort_array(F.collect_list(F.when(~later, F.struct("time", "name", "surprise")))).alias("past"),
    )
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    time = dict(events.dtypes)["time"]
    joined = rows.join(lists, F.col(now) == F.col("__now"), "left").drop("__now")
    return joined.withColumns({"upcoming": none("upcoming", f"array<struct<time:{time},name:string>>"), "past": none("past", f"array<struct<time:{time},name:string,surprise:double>>")})


JOURNAL = "cycle_id string, event string, time timestamp, status string, agent string, tokens long, broken string"


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """The records of JSON lines; blank lines are none, and of a torn line only its text is there, in `broken`."""
    lines = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return lines


#: What a million tokens of each kind cost by model, and what writing to and reading from a cache costs of an input token.
PRICED = "model string, input double, output double"
WRITE, READ = 1.25, 0.1


def usage_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (agent, model, input, output, cache_write, cache_read) with tokens and cost; prices (model, input, output) is small.

    A model without a price costs as much as the dearest. A call that was declined before any output (declined) isn't billed.
    """
    worst = prices.agg(F.max_by(F.struct("input", "output"), F.struct("output", "input")).alias("__worst"))
    priced = calls.join(F.broadcast(prices.select("model", F.struct("input", "output").alias("__price"))), "model", "left").join(F.broadcast(worst), F.lit(True), "left")
    p = F.coalesce("__price", "__worst")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    tokens = n("input") + n("output") + n("cache_write") + n("cache_read")
    cost = (p["input"] * (n("input") + WRITE * n("cache_write") + READ * n("cache_read")) + p["output"] * n("output")) / 1e6
    free = F.coalesce(F.col("declined"), F.lit(False)) if "declined" in calls.columns else F.lit(False)
    billed = lambda x, none: F.when(free, F.lit(none)).otherwise(x)
    return priced.withColumns({"tokens": billed(tokens, 0), "cost": billed(cost, 0.0), "unbilled": F.when(free, n("input") + n("cache_write") + n("cache_read")).otherwise(0)}).drop("__price", "__worst")


def usage_summary(costs: DataFrame, keys: list[str] = ("agent",), *, most_cost: float | None = None, most_tokens: int | None = None) -> DataFrame:
    """(keys, calls, tokens, unbilled, cost, used, over): a row a group, and one with null keys for all; costs are summed up in billionths, in any order alike; used is the greatest share of a budget."""
    sums = [F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("unbilled").alias("unbilled"), (F.sum(F.round(F.col("cost") * 1e9).cast("long")) / 1e9).alias("cost")]
    rows = costs.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*sums)
    shares = [F.lit(0.0)] + ([F.col("cost") / most_cost] if most_cost else []) + ([F.col("tokens") / most_tokens] if most_tokens else [])
    used = F.greatest(*shares) if len(shares) > 1 else shares[0]
    return rows.withColumn("used", used).withColumn("over", F.col("used") >= 1)
