"""Exponentially weighted and other recursive kernels, one series at a time.

A recursion over a series can't be a frame; pandas runs it, Arrow-batched, with one task per series.
Weights, warm-up and null rules are those of pandas.ewm (ignore_na=False).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def whole_series(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Frames that hold complete series, of batches sorted by series; only the last series of a batch is held back."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy()
        last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
        if last == 0 and held and held[-1][by].iloc[-1] == keys[0]:
            held.append(batch)
            continue
        done = [*held, batch.iloc[:last]]
        done = [d for d in done if len(d)]
        if done:
            yield pd.concat(done, ignore_index=True) if len(done) > 1 else done[0].reset_index(drop=True)
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bounds of runs of equal keys."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True)


def by_series(df: DataFrame, by: str, order: str) -> DataFrame:
    """df dealt out by series and sorted, for mapInPandas: thousands of short series share a task's batches."""
    return df.repartition(by).sortWithinPartitions(by, order)


def with_kernels(bars: DataFrame, kernels: dict[str, Callable[[pd.DataFrame], pd.Series]], *, by: str = "series_id", order: str = "time", kind: str = "double") -> DataFrame:
    """bars with a column per kernel; a kernel gets a series in time order and returns as many values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_series(batches, by):
            out = {n: np.empty(len(whole)) for n in kernels}
            for s, e in spans(whole[by].to_numpy()):
                one = whole.iloc[s:e].reset_index(drop=True)
                for n, k in kernels.items():
                    out[n][s:e] = np.asarray(k(one), dtype=float)
            yield whole.assign(**out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    return by_series(bars, by, order).mapInPandas(run, fields + "".join(f", `{n}` {kind}" for n in kernels))


def ema(x: pd.Series, span: float, least: int | None = None) -> pd.Series:
    return x.ewm(span=span, adjust=False, min_periods=int(span) if least is None else least).mean()


def wilder(x: pd.Series, n: int, least: int | None = None) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n if least is None else least).mean()


def log_returns(p: pd.DataFrame) -> pd.Series:
    return np.log(p["close"]).diff()


def ewma_vol(p: pd.DataFrame, halflife: float, least: int) -> pd.Series:
    return np.sqrt((log_returns(p) ** 2).ewm(halflife=halflife, adjust=False, min_periods=least).mean())


def ewm_std(p: pd.DataFrame, span: float) -> pd.Series:
    return log_returns(p).ewm(span=span, adjust=True, min_periods=max(2, int(span / 4))).std()


def rsi(p: pd.DataFrame, n: int) -> pd.Series:
    d = p["close"].diff()
    up, down = wilder(d.clip(lower=0), n), wilder((-d).clip(lower=0), n)
    total = up + down
    return (100 * up / total.where(total > 0)).where(~(total == 0), 50.0)


def true_range(p: pd.DataFrame) -> pd.Series:
    before = p["close"].shift()
    return pd.concat([p["high"] - p["low"], (p["high"] - before).abs(), (p["low"] - before).abs()], axis=1).max(axis=1)


def atr(p: pd.DataFrame, n: int, least: int | None = None) -> pd.Series:
    return wilder(true_range(p), n, least)


def adx(p: pd.DataFrame, n: int) -> pd.DataFrame:
    """adx, plus_di, minus_di."""
    up, down = p["high"].diff(), -p["low"].diff()
    a = atr(p, n)
    plus = 100 * wilder(up.where((up > down) & (up > 0), 0.0).where(up.notna()), n) / a
    minus = 100 * wilder(down.where((down > up) & (down > 0), 0.0).where(down.notna()), n) / a
    total = plus + minus
    dx = (100 * (plus - minus).abs() / total.where(total > 0)).where(~(total == 0), 0.0)
    return pd.DataFrame({"adx": wilder(dx, n), "plus_di": plus, "minus_di": minus})


def macd(p: pd.DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> pd.DataFrame:
    line = ema(p["close"], fast) - ema(p["close"], slow)
    smooth = ema(line, signal)
    return pd.DataFrame({"line": line, "signal": smooth, "hist": line - smooth})


def cusum_events(p: pd.DataFrame, threshold: float) -> pd.Series:
    """+-1 where the cumulated log return has left the band and is reset, else 0."""
    out, high, low = [], 0.0, 0.0
    for r in log_returns(p).fillna(0.0):
        high, low = max(0.0, high + r), min(0.0, low + r)
        side = 1.0 if high > threshold else -1.0 if low < -threshold else 0.0
        if side:
            high = low = 0.0
        out.append(side)
    return pd.Series(out)


def percentile_rank(x: pd.Series, n: int, least: int) -> pd.Series:
    """Average-rank percentile in a long window."""
    return x.rolling(n, min_periods=least).rank(pct=True)


def linreg(y: pd.Series, n: int, block: int = 16_384) -> pd.DataFrame:
    """slope a bar and r2 of the newest n values (rolling.linreg), a block of windows at once; a constant window has no r2."""
    v, at = y.to_numpy(dtype=float), np.arange(n) - (n - 1) / 2
    slope, r2 = np.full(len(v), np.nan), np.full(len(v), np.nan)
    for a in range(n - 1, len(v), block):
        b = min(a + block, len(v))
        d = np.lib.stride_tricks.sliding_window_view(v[a - n + 1 : b], n)
        d = d - d[:, :1]  # equal values become zeros
        d -= d.mean(axis=1, keepdims=True)
        both, own = d @ at, (d * d).sum(axis=1)
        slope[a:b] = both / (at @ at)
        r2[a:b] = np.divide(both * both, own * (at @ at), out=np.full(b - a, np.nan), where=own > 0)
    return pd.DataFrame({"slope": slope, "r2": r2})


def ewma_mean(x: pd.Series, halflife: float, least: int = 1) -> pd.Series:
    """The mean with weights that halve, normalised from the first value on."""
    return x.ewm(halflife=halflife, adjust=True, min_periods=least).mean()


def bar_volatility(p: pd.DataFrame, halflife: float, least: int) -> pd.Series:
    """The normalised form of ewma_vol; what isn't positive is missing."""
    v = np.sqrt((log_returns(p) ** 2).ewm(halflife=halflife, adjust=True, min_periods=least).mean())
    return v.where(v > 0)


def annual_volatility(p: pd.DataFrame, halflife: float, bars_per_year: float, least: int = 20, floor: float = 0.03, cap: float = 1.0, missing: float = 0.20) -> pd.Series:
    """ewma_vol a year, within floor and cap, and a stated value where there is none."""
    return (ewma_vol(p, halflife, least) * np.sqrt(bars_per_year)).clip(floor, cap).fillna(missing)
