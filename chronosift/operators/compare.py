"""Comparing frames column by column, research windows, and ledgers of spent holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parity_report(a: DataFrame, b: DataFrame, columns: list[str], keys: list[str], atol: float = 1e-9) -> DataFrame:
    """(column, rows, largest, mismatches, null_mismatches) over the keys that both have, in one aggregate."""
    both = a.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns]), keys)
    parts = []
    for c in columns:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        gap = F.abs(x - y)
        parts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.max(gap).alias("largest"), F.count_if(gap > atol).alias("mismatches"), F.count_if(x.isNull() != y.isNull()).alias("null_mismatches")).alias(c))
    return both.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def research_window(bars: DataFrame, *, start: str | None = None, end: str | None = None, holdout: str | None = None, spent: DataFrame | None = None) -> DataFrame:
    """Bars in [start, end], a bare end date meaning its whole day, before the holdout and before any spent one."""
    out = bars
    if start:
        out = out.filter(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        last = F.lit(end).cast("timestamp_ntz")
        out = out.filter(F.col("time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz") if len(end) == 10 else F.col("time") <= last)
    limits = [holdout] if holdout else []
    if spent is not None and (first := spent.agg(F.min("start")).head()[0]) is not None:
        limits.append(str(first))
    for x in limits:
        out = out.filter(F.col("time") < F.lit(x).cast("timestamp_ntz"))
    return out


def prior_looks(ledger: DataFrame, *, start: str, end: str, config_hash: str) -> DataFrame:
    """Ledger rows (start, end, config_hash) of other configurations whose window overlaps [start, end]."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return ledger.filter((F.col("start") <= t(end)) & (F.col("end") >= t(start)) & (F.col("config_hash") != config_hash))
