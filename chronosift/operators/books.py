"""What a book earned: fills, round trips, daily marks, metrics, attribution, halts. All are frames and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import series

DAYS = 252


def trading_date(time: Column, width: str | None = None, *, fold: bool = True) -> Column:
    """The day of a bar's close (midnight belongs to the day that ends), weekends counted to Monday.

    Without a width the day of the time itself.
    """
    at = time if width is None else time + F.expr(f"INTERVAL {width}") - F.expr("INTERVAL '0.000001' SECOND")
    day = F.to_date(at)
    return F.when(F.weekday(day) >= 5, F.next_day(day, "Mon")).otherwise(day) if fold else day


def session_date(time: Column, anchor: int) -> Column:
    """The trading date of a daily bucket that is anchored at an hour."""
    return F.to_date(time + F.make_dt_interval(hours=F.lit((24 - anchor) % 24)))


def daily_equity(book: DataFrame, width: str | None = None, *, fold: bool = True) -> DataFrame:
    """(series_id, date, equity): the last mark of each trading day."""
    rows = book.filter(F.col("equity").isNotNull()).select("series_id", trading_date(F.col("time"), width, fold=fold).alias("date"), "time", "equity")
    return rows.groupBy("series_id", "date").agg(F.max_by("equity", "time").alias("equity"))


def daily_returns(book: DataFrame, width: str | None = None, *, initial: float | None = None, fold: bool = True) -> DataFrame:
    """(series_id, date, equity, ret); the first day counts from `initial`, or from the first mark."""
    days = daily_equity(book, width, fold=fold)
    w = Window.partitionBy("series_id").orderBy("date")
    if initial is None:
        first = book.filter(F.col("equity").isNotNull()).groupBy("series_id").agg(F.min_by("equity", "time").alias("__base"))
        days = days.join(first, "series_id")
    else:
        days = days.withColumn("__base", F.lit(float(initial)))
    before = F.coalesce(F.lag("equity").over(w), F.col("__base"))
    return days.withColumn("ret", F.try_divide(F.col("equity"), before) - 1).drop("__base")


def fills(book: DataFrame) -> DataFrame:
    """(series_id, time, side, lots, price, closing, cost, position_after): one row a change of position.

    closing: the lots that reduce the former position; the rest opens.
    """
    w = series()
    before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    rows = book.withColumn("__b", before).filter(F.col("position") != F.col("__b"))
    traded = F.abs(F.col("position") - F.col("__b"))
    closing = F.when(F.col("__b") * (F.col("position") - F.col("__b")) < 0, F.least(F.abs("__b"), traded)).otherwise(0.0)
    return rows.select("series_id", "time", F.signum(F.col("position") - F.col("__b")).alias("side"), traded.alias("lots"), F.col("open").alias("price"), closing.alias("closing"), "cost", F.col("position").alias("position_after"))


def trades(book: DataFrame, contract: float = 100.0) -> DataFrame:
    """(series_id, trade, side, entry_time, exit_time, bars_held, lots, entry_price, gross, cost, pnl, open).

    A trade is a run of positions on one side; scaling in and out stays in it, a reversal ends it and shares its
    cost by the lots that close and open. The move from the last close to the exit's open belongs to it. lots: the
    largest position; entry_price: the mean of its opening fills. The last trade may still be open.
    """
    w = series()
    side, p = F.signum("position"), F.col("position")
    rows = book.withColumns({"__b": F.coalesce(F.lag("position").over(w), F.lit(0.0)), "__pc": F.coalesce(F.lag("close").over(w), F.col("open")), "__side": side})
    b = F.col("__b")
    rows = rows.withColumn("__new", ((F.col("__side") != 0) & (F.signum(b) != F.col("__side"))).cast("long"))
    rows = rows.withColumn("trade", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    traded = F.abs(p - b)
    closing = F.when(b * (p - b) < 0, F.least(F.abs(b), traded)).otherwise(0.0)
    share = F.coalesce(F.try_divide(closing, traded), F.lit(0.0)) * F.col("cost")
    rows = rows.withColumns({"__closing": closing, "__opening": traded - closing, "__share": share, "__moved": contract * b * (F.col("open") - F.col("__pc"))})
    # what the former position's trade takes from this bar, and what the present one's does
    former = F.struct((F.col("trade") - F.col("__new")).alias("trade"), F.col("__moved").alias("gross"), F.col("__share").alias("cost"), F.lit(0).alias("held"), F.when(p * b <= 0, F.col("time")).alias("left"), F.lit(0.0).alias("opened"), F.lit(0.0).alias("paid"), F.lit(0.0).alias("size"), F.lit(None).cast("timestamp_ntz").alias("begun"), F.signum(b).alias("side"))
    present = F.struct(F.col("trade"), (contract * p * (F.col("close") - F.col("open"))).alias("gross"), (F.col("cost") - F.col("__share")).alias("cost"), F.lit(1).alias("held"), F.lit(None).cast("timestamp_ntz").alias("left"), F.col("__opening").alias("opened"), (F.col("__opening") * F.col("open")).alias("paid"), F.abs(p).alias("size"), F.col("time").alias("begun"), F.col("__side").alias("side"))
    each = rows.select("series_id", F.explode(F.filter(F.array(former, present), lambda x: x["side"] != 0)).alias("x")).select("series_id", "x.*")
    done = each.groupBy("series_id", "trade").agg(
        F.max("side").alias("side"), F.min("begun").alias("entry_time"), F.max("left").alias("exit_time"), F.sum("held").alias("bars_held"), F.max("size").alias("lots"),
        F.try_divide(F.sum("paid"), F.sum("opened")).alias("entry_price"), F.sum("gross").alias("gross"), F.sum("cost").alias("cost"),
    )
    return done.withColumns({"pnl": F.col("gross") - F.col("cost"), "open": F.col("exit_time").isNull()})


def trade_table(trades_: DataFrame) -> DataFrame:
    """(series_id, kind, n, win_rate, avg_win, avg_loss, payoff, profit_factor, expectancy, largest_win, largest_loss, avg_bars, cost): all, long and short."""
    kinds = F.array(F.lit("all"), F.when(F.col("side") > 0, F.lit("long")).otherwise(F.lit("short")))
    rows = trades_.withColumn("kind", F.explode(kinds))
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    return rows.groupBy("series_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.try_divide(F.avg(win), -F.avg(loss)).alias("payoff"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"), F.avg("pnl").alias("expectancy"),
        F.max("pnl").alias("largest_win"), F.min("pnl").alias("largest_loss"), F.avg("bars_held").alias("avg_bars"), F.sum("cost").alias("cost"),
    )


def unbiased(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> tuple[Column, Column, Column]:
    """Sample deviation, skewness and excess kurtosis from raw power sums."""
    m = s1 / n
    m2 = s2 / n - m * m
    m3 = s3 / n - 3 * m * s2 / n + 2 * m * m * m
    m4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    sd = F.sqrt(m2 * n / (n - 1))
    skew = F.when(n >= 3, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.try_divide(m3, F.pow(m2, F.lit(1.5))))
    kurt = F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.try_divide(m4, m2 * m2) - 3 * (n - 1)))
    return sd, skew, kurt


def metrics(book: DataFrame, *, width: str, bars_per_year: float, contract: float = 100.0) -> DataFrame:
    """One row a series with the 34 figures of a book (time, open, close, position, cost, equity).

    Returns and drawdowns count from the first mark; days are trading days.
    """
    w = series()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marks = book.withColumns({"__r": F.col("equity") / F.lag("equity").over(w) - 1, "__top": F.max("equity").over(so_far), "__turn": F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))})
    under = F.col("equity") < F.col("__top")
    marks = marks.withColumns({"__dd": F.col("equity") / F.col("__top") - 1, "__peak": F.max(F.when(~under, F.col("time"))).over(so_far)})
    # a stretch under water ends with the first bar back at its peak, or with the last bar
    marks = marks.withColumn("__under", F.when(under | F.lag(under).over(w), F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.when(under, F.col("__peak")).otherwise(F.lag("__peak").over(w)).cast("timestamp"))))
    bar = marks.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min_by("equity", "time").alias("__first"), F.max_by("equity", "time").alias("final_equity"),
        ((F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))) / 1e6 / (365.25 * 86400)).alias("years"),
        (F.try_divide(F.avg("__r"), F.stddev_samp("__r")) * math.sqrt(bars_per_year)).alias("sharpe_bar"), F.min("__dd").alias("max_drawdown"),
        (F.coalesce(F.max("__under"), F.lit(0)) / 86_400e6).alias("max_dd_duration_days"), F.avg((F.abs("position") > 1e-12).cast("double")).alias("exposure"),
        F.sum("__turn").alias("__traded"), F.sum("cost").alias("total_costs"), F.avg("equity").alias("__mean"),
    )
    d = daily_returns(book, width)
    p = lambda k: F.sum(F.pow(F.col("ret"), F.lit(float(k))))
    day = d.groupBy("series_id").agg(
        F.count("ret").alias("n_days"), *[p(k).alias(f"__s{k}") for k in (1, 2, 3, 4)], F.percentile("ret", F.array(F.lit(0.05), F.lit(0.95))).alias("__q"), F.max("ret").alias("best_day"), F.min("ret").alias("worst_day"),
        F.sqrt(F.sum(F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2.0))) / F.count("ret")).alias("__down"),
    )
    tail = d.join(day.select("series_id", F.col("__q")[0].alias("__q05")), "series_id").filter("ret <= __q05").groupBy("series_id").agg((-F.avg("ret")).alias("cvar_95_daily"))
    t = trades(book, contract)
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    deals = t.filter("NOT open").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.avg("pnl").alias("expectancy"), F.avg("bars_held").alias("avg_hold_bars"),
    )
    all_ = bar.join(day, "series_id").join(tail, "series_id").join(deals, "series_id", "left").na.fill(0, ["n_trades"])
    n = F.col("n_days").cast("double")
    sd, skew, kurt = unbiased(n, *[F.col(f"__s{k}") for k in (1, 2, 3, 4)])
    mean = F.col("__s1") / n
    grown = F.col("final_equity") / F.col("__first")
    cagr = F.when(F.col("years") > 0, F.when(F.col("final_equity") > 0, F.pow(grown, 1 / F.col("years")) - 1).otherwise(-1.0))
    all_ = all_.withColumns({"total_return": grown - 1, "cagr": cagr, "ann_vol": sd * math.sqrt(DAYS), "sharpe": F.try_divide(mean, sd) * math.sqrt(DAYS), "sortino": F.try_divide(mean, F.col("__down")) * math.sqrt(DAYS), "skew": skew, "kurtosis": kurt})
    all_ = all_.withColumns({
        "calmar": F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")), "var_95_daily": -F.col("__q")[0], "tail_ratio": F.try_divide(F.abs(F.col("__q")[1]), F.abs(F.col("__q")[0])),
        "trades_per_year": F.try_divide(F.col("n_trades"), F.col("years")), "turnover_lots_per_year": F.try_divide(F.col("__traded"), F.col("years")),
        "cost_drag_ann": F.try_divide(F.col("total_costs") / F.col("__mean"), F.col("years")), "bars_per_year": F.lit(float(bars_per_year)),
    })
    names = [
        "total_return", "cagr", "ann_vol", "sharpe", "sharpe_bar", "sortino", "max_drawdown", "calmar", "max_dd_duration_days", "skew", "kurtosis", "var_95_daily", "cvar_95_daily", "tail_ratio", "best_day", "worst_day",
        "n_trades", "trades_per_year", "win_rate", "profit_factor", "avg_win", "avg_loss", "expectancy", "avg_hold_bars", "exposure", "turnover_lots_per_year", "total_costs", "cost_drag_ann", "n_bars", "n_days", "years", "bars_per_year", "final_equity",
    ]
    return all_.select("series_id", *names)


def cost_attribution(book: DataFrame, parts: tuple[str, ...] = ("cost",)) -> DataFrame:
    """(series_id, each part's sum, gross, net, and costs as a share of gross)."""
    total = sum((F.sum(c) for c in parts), F.lit(0.0))
    return book.groupBy("series_id").agg(*[F.sum(c).alias(c) for c in parts], F.sum("gross").alias("gross"), (F.sum("gross") - total).alias("net"), F.try_divide(total, F.abs(F.sum("gross"))).alias("share_of_gross"))


def pnl_attribution(book: DataFrame, contributions: DataFrame, *, by_year: bool = False) -> DataFrame:
    """(series_id, [year,] strategy, pnl): each bar's pnl by the shares of the contributions a bar before.

    contributions has (series_id, time, strategy, contribution). Where they sum to 0 the pnl is 'unattributed'.
    """
    w = series()
    own = book.select("series_id", F.col("time").alias("__t"), "pnl", F.lag("time").over(w).alias("time"))
    total = Window.partitionBy("series_id", "time")
    shares = contributions.withColumn("share", F.try_divide(F.col("contribution"), F.sum("contribution").over(total)))
    live = shares.filter(F.col("share").isNotNull()).select("series_id", "time", "strategy", "share")
    split = own.join(live, ["series_id", "time"], "left").select("series_id", "__t", F.coalesce("strategy", F.lit("unattributed")).alias("strategy"), (F.col("pnl") * F.coalesce("share", F.lit(1.0))).alias("pnl"))
    keys = ["series_id", *(["year"] if by_year else []), "strategy"]
    return split.withColumn("year", F.year("__t")).groupBy(*keys).agg(F.sum("pnl").alias("pnl"))


def halt_episodes(book: DataFrame, halted: str = "halted") -> DataFrame:
    """(series_id, episodes, bars): runs of halted bars."""
    begins = F.col(halted) & ~F.coalesce(F.lag(halted).over(series()), F.lit(False))
    return book.withColumn("__n", begins.cast("long")).groupBy("series_id").agg(F.sum("__n").alias("episodes"), F.sum(F.col(halted).cast("long")).alias("bars"))


def risk_event_table(events: DataFrame, reasons: str = "reasons", sep: str = ";") -> DataFrame:
    """(rule, n, first, last): the leading word of every reason of each event."""
    each = events.select("time", F.explode(F.split(reasons, sep)).alias("r"))
    rule = F.regexp_extract(F.trim("r"), r"^([A-Za-z_]+)", 1)
    return each.select("time", rule.alias("rule")).filter("rule <> ''").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def window_sharpe(book: DataFrame, start: str, stop: str, width: str) -> DataFrame:
    """(series_id, days, ret, sharpe) of the daily returns from start to before stop."""
    inside = daily_returns(book, width).filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(stop).cast("date")) & F.col("ret").isNotNull())
    grown = F.exp(F.sum(F.log1p("ret"))) - 1
    return inside.groupBy("series_id").agg(F.count("ret").alias("days"), grown.alias("ret"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(DAYS)).alias("sharpe"))
