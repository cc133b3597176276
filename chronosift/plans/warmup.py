"""How far feature groups look back, and features of the newest bars from no more bars than that.

A group's look-back follows from its own parameters: frames count as long as they are, averages with exponential memory until what is
older weighs less than 2^-HALVES. A snapshot reads each series' newest bars by rank, so its cost doesn't grow with history.
"""

from __future__ import annotations

import inspect
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronosift.plans.features import GROUPS, Pipeline

HALVES = 40
#: Runs of returns of one sign that are told apart.
STREAK = 64
#: Fast and slow average and signal of the convergence of averages, which has no parameters.
MACD = (12, 26, 9)


def tail(halflife: float) -> int:
    return math.ceil(HALVES * halflife)


def span_tail(span: float) -> int:
    """Of an average whose newest value weighs 2 / (span + 1)."""
    return tail(-math.log(2) / math.log1p(-2 / (span + 1))) if span > 1 else 1


def wilder_tail(n: int) -> int:
    """Of an average whose newest value weighs 1 / n."""
    return tail(-math.log(2) / math.log1p(-1 / n)) if n > 1 else 1


def parameters(group: str, given: dict | None = None) -> dict:
    """A group's parameters with defaults; names that it doesn't have are an error."""
    known = {k: v.default for k, v in list(inspect.signature(GROUPS[group]).parameters.items())[1:]}
    unknown = set(given or {}) - set(known)
    if unknown:
        raise ValueError(f"{group} has no parameter {sorted(unknown)}")
    return known | (given or {})


def _trend(p: dict) -> int:
    return max(span_tail(max(p["spans"])) + 5, 2 * wilder_tail(p["atr_n"]) + 1, span_tail(MACD[1]) + span_tail(MACD[2]), max(p["windows"]))


_BACK = {
    "returns": lambda p: max(max(p["horizons"]) + 1, tail(p["halflife"]) + 1),
    "trend": _trend,
    "momentum": lambda p: max(max(p["horizons"]) + 1, tail(50) + 1, wilder_tail(max(p["rsi_periods"])) + 1, p["stoch_n"] + 2, 21),
    "meanrev": lambda p: max(*p["windows"], 20, STREAK + 1),
    "range": lambda p: max(*p["windows"], wilder_tail(p["atr_n"]) + 1, 7),
    "volatility": lambda p: max(tail(50) + 1, wilder_tail(14) + 1, sum((p["windows"][0], p["windows"][-1])) + 1, max(p["windows"]) + 1),
    "microstructure": lambda p: max(p["z_window"], p["autocorr"] + 2, wilder_tail(14) + 1),
    "session": lambda p: 1,
    "mtf": lambda p: max(tail(20) + 1, wilder_tail(14) + 1, span_tail(20), 21) + 2,
    "macro": lambda p: 1,
    "calendar": lambda p: 1,
    "regime": lambda p: max(p["rank"] + p["vol_window"], 64 + 4),
}


def group_lookback(pipe: Pipeline, group: str, *, bars_per_width: int = 4) -> int:
    """Bars that a group's newest row needs; those of larger bars count bars_per_width each."""
    back = _BACK[group](parameters(group, pipe.params.get(group)))
    return back * bars_per_width if group == "mtf" else back


def max_lookback(pipe: Pipeline, *, bars_per_width: int = 4) -> int:
    return max((group_lookback(pipe, g, bars_per_width=bars_per_width) for g in pipe.groups), default=1)


def newest(bars: DataFrame, n: int) -> DataFrame:
    """The n newest bars of each series."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("time")))
    return bars.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def snapshot(pipe: Pipeline, bars: DataFrame, rows: int = 1, *, bars_per_width: int = 4, scaled: bool = True, **inputs: DataFrame) -> DataFrame:
    """The features of each series' newest rows, as a run over all bars gives them, from max_lookback bars more.

    scaled: by the pipeline's stats, if it is fitted. A column that is null in a row that is read stays null (or 0, scaled) as in the whole run.
    """
    read = newest(bars, max_lookback(pipe, bars_per_width=bars_per_width) + rows - 1)
    raw = pipe.compute(read, **inputs)
    return newest(pipe.transform(raw) if scaled and pipe.stats else raw, rows)


def to_json(pipe: Pipeline) -> str:
    """Groups, their parameters (defaults written out), limit and fitted stats."""
    return json.dumps({"groups": pipe.groups, "params": {g: {k: v for k, v in parameters(g, pipe.params.get(g)).items() if v is not None and not isinstance(v, DataFrame)} for g in pipe.groups}, "limit": pipe.limit, "stats": pipe.stats})


def from_json(said: str) -> Pipeline:
    saved = json.loads(said)
    pipe = Pipeline(saved["groups"], saved["params"], saved["limit"])
    pipe.stats = {c: tuple(v) for c, v in saved["stats"].items()}
    return pipe


def stats_table(pipe: Pipeline, spark) -> DataFrame:
    """(column, location, scale) of a fitted pipeline."""
    return spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in pipe.stats.items()], "column string, location double, scale double")
