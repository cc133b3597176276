"""Feature groups on bars, their registry, and the train-only scaler."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions import ewm
from chronosift.functions.scalars import clip, log_pos, safe_div, tsmom_response
from chronosift.operators import islands, rolling
from chronosift.operators.asof import asof_join
from chronosift.operators.resample import BAR_COLUMNS, resample_bars
from chronosift.operators.rolling import series

GROUPS: dict[str, Callable[..., DataFrame]] = {}


def feature(name: str):
    """Registers a group: a function of bars (and keyword inputs) that adds columns `name_*`."""

    def add(f):
        GROUPS[name] = f
        return f

    return add


def _r(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", rolling.log_return(F.col("close")))


@feature("returns")
def returns(bars: DataFrame, horizons=(1, 2, 3, 4, 6, 8, 12, 24, 48), halflife: float = 50) -> DataFrame:
    out = ewm.with_kernels(bars, {"v": lambda p: ewm.ewma_vol(p, halflife, 20)})
    z = {f"returns_z_{h}": safe_div(rolling.log_return(F.col("close"), h), F.col("v") * math.sqrt(h)) for h in horizons}
    return out.withColumns({"returns_log_1": rolling.log_return(F.col("close"))} | z).drop("v")


@feature("trend")
def trend(bars: DataFrame, spans=(20, 50, 100), atr_n: int = 14, windows=(20, 50, 100)) -> DataFrame:
    kernels = {f"e{s}": (lambda p, s=s: ewm.ema(p["close"], s)) for s in spans} | {"a": lambda p: ewm.atr(p, atr_n)}
    for part in ("line", "signal", "hist"):
        kernels[f"m_{part}"] = lambda p, part=part: ewm.macd(p)[part]
    kernels |= {"trend_adx": lambda p: ewm.adx(p, atr_n)["adx"], "trend_di_diff": lambda p: (x := ewm.adx(p, atr_n))["plus_di"] - x["minus_di"]}
    # frames of a series are one task's work, and regressions by frame by far the most of it
    for n in windows:
        kernels |= {f"l{n}": (lambda p, n=n: ewm.linreg(p["close"], n)["slope"]), f"trend_lin_r2_{n}": (lambda p, n=n: ewm.linreg(p["close"], n)["r2"])}
    rows = ewm.with_kernels(bars, kernels)
    new: dict[str, Column] = {f"trend_dist_{s}": safe_div(F.col("close") - F.col(f"e{s}"), F.col("a")) for s in spans}
    new |= {f"trend_slope_{s}": safe_div(F.col(f"e{s}") - F.lag(f"e{s}", 5).over(series()), F.col("a")) for s in spans}
    new |= {f"trend_macd_{x}": safe_div(F.col(f"m_{x}"), F.col("a")) for x in ("line", "signal", "hist")}
    new |= {f"trend_lin_t_{n}": safe_div(F.col(f"l{n}") * n, F.col("a")) for n in windows}
    return rows.withColumns(new).drop("a", *[k for k in kernels if not k.startswith("trend_")])


@feature("momentum")
def momentum(bars: DataFrame, rsi_periods=(2, 14), horizons=(24, 48, 120), stoch_n: int = 14) -> DataFrame:
    kernels = {f"momentum_rsi_{n}": (lambda p, n=n: ewm.rsi(p, n)) for n in rsi_periods} | {"v": lambda p: ewm.ewma_vol(p, 50, 20)}
    rows = _r(ewm.with_kernels(bars, kernels)).withColumn("momentum_stoch_k", rolling.stochastic(stoch_n))
    z = {f"momentum_z_{h}": safe_div(rolling.log_return(F.col("close"), h), F.col("v") * math.sqrt(h)) for h in horizons}
    rows = rows.withColumns(z)
    more = {f"momentum_resp_{h}": tsmom_response(F.col(f"momentum_z_{h}")) for h in horizons}
    more |= {"momentum_stoch_d": rolling.mean(F.col("momentum_stoch_k"), 3), "momentum_up_frac": rolling.mean(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double")), 20)}
    return rows.withColumns(more).drop("v", "r")


@feature("meanrev")
def meanrev(bars: DataFrame, windows=(20, 50, 100)) -> DataFrame:
    pct_b, width = rolling.bollinger(20, 2.0, F.col("close"))
    rows = bars.withColumns({f"meanrev_z_{n}": rolling.zscore(F.col("close"), n) for n in windows} | {"meanrev_pct_b": pct_b, "meanrev_width": width})
    return islands.streaks(_r(rows), "r", "meanrev_streak").drop("r")


@feature("range")
def range_(bars: DataFrame, windows=(20, 55), atr_n: int = 14) -> DataFrame:
    rows = ewm.with_kernels(bars, {"a": lambda p: ewm.atr(p, atr_n)})
    size = F.col("high") - F.col("low")
    new = {}
    for n in windows:
        top, low = rolling.donchian(n)
        new |= {f"range_pos_{n}": safe_div(F.col("close") - low, top - low), f"range_width_{n}": safe_div(top - low, F.col("a"))}
    before = lambda c: F.lag(c).over(series())
    new |= {
        "range_body": safe_div(F.col("close") - F.col("open"), size, 0.0),
        "range_upper": safe_div(F.col("high") - F.greatest("open", "close"), size, 0.0),
        "range_lower": safe_div(F.least("open", "close") - F.col("low"), size, 0.0),
        "range_clv": safe_div(2 * F.col("close") - F.col("high") - F.col("low"), size, 0.0),
        "range_bar_atr": safe_div(size, F.col("a")),
        "range_inside": ((F.col("high") <= before("high")) & (F.col("low") >= before("low"))).cast("double"),
        "range_outside": ((F.col("high") > before("high")) & (F.col("low") < before("low"))).cast("double"),
        "range_nr7": rolling.guarded((size <= F.min(size).over(rolling.frame(7))).cast("double"), size, 7),
    }
    return rows.withColumns(new).drop("a")


@feature("volatility")
def volatility(bars: DataFrame, windows=(20, 60), bars_per_year: float = 6048.0) -> DataFrame:
    rows = _r(ewm.with_kernels(bars, {"a": lambda p: ewm.atr(p, 14), "e": lambda p: ewm.ewma_vol(p, 50, 20)})).withColumn("gap", F.ln(F.col("open") / F.lag("close").over(series())))
    new = {"volatility_ewma": F.col("e") * math.sqrt(bars_per_year), "volatility_atr_pct": safe_div(F.col("a"), F.col("close"))}
    for n in windows:
        new |= {f"volatility_{k}_{n}": f(n, bars_per_year) for k, f in (("cc", rolling.close_to_close_vol), ("pk", rolling.parkinson_vol), ("gk", rolling.garman_klass_vol), ("rs", rolling.rogers_satchell_vol), ("yz", rolling.yang_zhang_vol))}
    rows = rows.withColumns(new)
    a, b = windows[0], windows[-1]
    return rows.withColumns({"volatility_ratio": log_pos(safe_div(F.col(f"volatility_cc_{a}"), F.col(f"volatility_cc_{b}"))), "volatility_of_vol": rolling.std(F.col(f"volatility_cc_{a}"), b)}).drop("a", "e", "r", "gap")


@feature("microstructure")
def microstructure(bars: DataFrame, z_window: int = 100, autocorr: int = 50) -> DataFrame:
    rows = _r(ewm.with_kernels(bars, {"a": lambda p: ewm.atr(p, 14)})).withColumns({"ls": log_pos(F.col("spread")), "lv": F.log1p("volume")})
    rows = rows.withColumn("r1", F.lag("r").over(series()))
    gap = F.col("open") - F.lag("close").over(series())
    return rows.withColumns({
        "microstructure_spread_bps": safe_div(F.col("spread") * 10_000, F.col("close")),
        "microstructure_spread_z": rolling.zscore(F.col("ls"), z_window),
        "microstructure_spread_atr": safe_div(F.col("spread"), F.col("a")),
        "microstructure_volume_z": rolling.zscore(F.col("lv"), z_window),
        "microstructure_gap_atr": safe_div(gap, F.col("a")),
        "microstructure_autocorr": rolling.correlation(F.col("r"), F.col("r1"), autocorr),
    }).drop("a", "r", "r1", "ls", "lv")


def local_hour(time: Column, zone: str) -> tuple[Column, Column]:
    """Weekday (Monday 0) and fractional hour in a zone, daylight saving included."""
    at = F.from_utc_timestamp(time.cast("timestamp"), zone)
    return F.weekday(at), F.hour(at) + F.minute(at) / 60.0


@feature("session")
def session(bars: DataFrame) -> DataFrame:
    t = F.col("time")
    day, hour = local_hour(t, "UTC")
    _, london = local_hour(t, "Europe/London")
    _, tokyo = local_hour(t, "Asia/Tokyo")
    ny_day, ny = local_hour(t, "America/New_York")
    inside = lambda h, a, b: ((h >= a) & (h < b)).cast("double")
    return bars.withColumns({
        "session_hour_sin": F.sin(2 * math.pi * hour / 24),
        "session_hour_cos": F.cos(2 * math.pi * hour / 24),
        "session_week_sin": F.sin(2 * math.pi * (day * 24 + hour) / 168),
        "session_week_cos": F.cos(2 * math.pi * (day * 24 + hour) / 168),
        "session_asia": inside(tokyo, 9, 18),
        "session_london": inside(london, 8, 17),
        "session_ny": inside(ny, 8, 17),
        "session_overlap": inside(london, 8, 17) * inside(ny, 8, 17),
        "session_rollover": inside(ny, 16, 18),
        "session_friday_late": ((ny_day == 4) & (ny >= 12)).cast("double"),
    })


@feature("mtf")
def mtf(bars: DataFrame, width: str = "4 hours", shift: str = "2 hours") -> DataFrame:
    htf = resample_bars(bars, width, shift=shift)
    rows = ewm.with_kernels(htf, {"v": lambda p: ewm.ewma_vol(p, 20, 10), "rsi": lambda p: ewm.rsi(p, 14), "e": lambda p: ewm.ema(p["close"], 20), "a": lambda p: ewm.atr(p, 14)})
    top, low = rolling.donchian(20)
    htf = rows.select("series_id", F.col("available_at").alias("htf_at"), safe_div(rolling.log_return(F.col("close")), F.col("v")).alias("mtf_ret_z"), F.col("rsi").alias("mtf_rsi"), safe_div(F.col("close") - F.col("e"), F.col("a")).alias("mtf_dist"), safe_div(F.col("close") - low, top - low).alias("mtf_pos"))
    return asof_join(bars, htf, on=["series_id"], left_time="available_at", right_time="htf_at", columns=["mtf_ret_z", "mtf_rsi", "mtf_dist", "mtf_pos"])


@feature("macro")
def macro(bars: DataFrame, macro: DataFrame | None = None, change_days: int = 5) -> DataFrame:
    """The newest published value of each macro series, and its log change."""
    out = bars
    w = Window.partitionBy("name").orderBy("date")
    rows = macro.withColumn("change", F.ln(F.col("value") / F.lag("value", change_days).over(w)))
    for (name,) in sorted(tuple(r) for r in macro.select("name").distinct().collect()):
        key = "".join(c if c.isalnum() else "_" for c in name.lower())
        one = rows.filter(F.col("name") == name).select(F.col("available_at").alias("published"), F.col("value").alias(f"macro_{key}"), F.col("change").alias(f"macro_{key}_change"))
        out = asof_join(out, one, left_time="available_at", right_time="published", columns=[f"macro_{key}", f"macro_{key}_change"])
    return out


@feature("calendar")
def calendar(bars: DataFrame, events: DataFrame | None = None, cap_hours: float = 72.0) -> DataFrame:
    at = events.select("time").distinct()
    out = asof_join(bars, at.select(F.col("time").alias("next_event")), right_time="next_event", columns=["next_event"], forward=True)
    out = asof_join(out, at.select(F.col("time").alias("last_event")), right_time="last_event", columns=["last_event"], strict=True)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = lambda a, b: F.least(F.coalesce((us(b) - us(a)) / 3_600_000_000.0, F.lit(cap_hours)), F.lit(cap_hours))
    return out.withColumns({"calendar_to_next": hours("time", "next_event"), "calendar_since_last": hours("last_event", "time")}).drop("next_event", "last_event")


@feature("regime")
def regime(bars: DataFrame, vol_window: int = 20, rank: int = 500, least: int = 100) -> DataFrame:
    rows = _r(bars).withColumns({"d": F.col("close") - F.lag("close").over(series()), "r4": rolling.log_return(F.col("close"), 4)})
    rows = rows.withColumn("v", rolling.std(F.col("r"), vol_window))
    ranked = ewm.with_kernels(rows, {"regime_vol_rank": lambda p: ewm.percentile_rank(p["v"].astype(float), rank, least)})
    return ranked.withColumns({
        "regime_high_vol": (F.col("regime_vol_rank") > 0.8).cast("double"),
        "regime_low_vol": (F.col("regime_vol_rank") < 0.2).cast("double"),
        "regime_er": rolling.efficiency_ratio(20, F.col("d"), F.col("close")),
        "regime_vr": rolling.variance_ratio(4, 60, F.col("r"), F.col("r4")),
    }).drop("r", "d", "r4", "v")


class Pipeline:
    """compute, fit on training rows only, transform."""

    def __init__(self, groups: list[str], params: dict[str, dict] | None = None, limit: float = 5.0) -> None:
        self.groups = [g for g in GROUPS if g in groups]
        self.params, self.limit, self.stats = params or {}, limit, {}

    def compute(self, bars: DataFrame, **inputs: DataFrame) -> DataFrame:
        out = bars
        for g in self.groups:
            if g == "macro" and "macro" not in inputs or g == "calendar" and "events" not in inputs:
                continue
            more = {"macro": {"macro": inputs.get("macro")}, "calendar": {"events": inputs.get("events")}}.get(g, {})
            # each group adds its columns to the same frame: no join back
            out = GROUPS[g](out, **more, **self.params.get(g, {}))
        return out.select(*bars.columns, *[c for c in out.columns if c not in bars.columns])

    def fit(self, train: DataFrame) -> Pipeline:
        """One aggregate: location and scale of every column; constant columns are dropped."""
        cols = [c for c in train.columns if c not in BAR_COLUMNS]
        aggs = []
        for i, c in enumerate(cols):
            x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
            aggs += [F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        r = train.agg(*aggs).head()
        self.stats = {}
        for i, c in enumerate(cols):
            if r[f"a{i}"] is None or r[f"a{i}"] == r[f"b{i}"]:
                continue
            scale = (r[f"q{i}"][2] - r[f"q{i}"][0]) * 0.7413 or r[f"s{i}"]
            self.stats[c] = (r[f"q{i}"][1], scale) if scale and math.isfinite(scale) else (0.0, 1.0)
        return self

    def transform(self, raw: DataFrame) -> DataFrame:
        """(x - location) / scale, clipped; nulls become 0 once a column has had a value."""
        up_to = series().rowsBetween(Window.unboundedPreceding, 0)
        out = []
        for c, (loc, scale) in self.stats.items():
            x = clip((F.col(c) - loc) / scale, -self.limit, self.limit)
            seen = F.count(F.col(c)).over(up_to) > 0
            out.append(F.when(x.isNotNull(), x).when(seen, F.lit(0.0)).alias(c))
        return raw.select("series_id", "time", *out)


def leakage(compute: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: str, columns: list[str]) -> int:
    """How many values up to `cut` change if every later price does (0 for a causal feature)."""
    late = F.col("time") > F.lit(cut).cast("timestamp_ntz")
    bent = bars.withColumns({c: F.when(late, F.col(c) * 3.7).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    a, b = compute(bars).filter(~late), compute(bent).filter(~late)
    both = a.select("series_id", "time", *columns).join(b.select("series_id", "time", *[F.col(c).alias(f"__{c}") for c in columns]), ["series_id", "time"])
    differs = lambda c: ~(F.col(c).eqNullSafe(F.col(f"__{c}")) | (F.abs(F.col(c) - F.col(f"__{c}")) < 1e-9))
    return both.agg(*[F.count_if(F.coalesce(differs(c), F.lit(True))) for c in columns]).toPandas().sum(axis=1).iloc[0].item()

