"""LZMA candle files: 24-byte big-endian records (seconds, open, close, low, high, volume)."""

from __future__ import annotations

import lzma
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = np.dtype([("t", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])


def decode(raw: bytes, scale: float, period: int = 86_400) -> pd.DataFrame:
    """Records with positive prices in order, a finite volume and a second within the period; the last of each second.

    An empty file holds none; a torn last record is dropped. A file that can't be decompressed raises ValueError.
    """
    try:
        data = lzma.decompress(raw) if raw else b""
    except lzma.LZMAError as e:
        raise ValueError(f"a candle file is corrupt: {e}") from e
    x = np.frombuffer(data[: len(data) // RECORD.itemsize * RECORD.itemsize], RECORD)
    out = pd.DataFrame({"second": x["t"].astype(np.int64), **{c: x[c].astype(float) / scale for c in ("open", "high", "low", "close")}, "volume": x["volume"].astype(float)})
    prices = out[["open", "high", "low", "close"]]
    good = (prices > 0).all(axis=1) & (out["high"] >= prices.max(axis=1)) & (out["low"] <= prices.min(axis=1)) & np.isfinite(out["volume"]) & (out["volume"] >= 0) & (out["second"] < period)
    return out[good].drop_duplicates("second", keep="last").sort_values("second")


def read_candles(spark: SparkSession, paths: str | list[str], *, scale: float, day_pattern: str = r"(\d{4}-\d{2}-\d{2})", skip_corrupt: bool = False) -> DataFrame:
    """(day, time, open, high, low, close, volume) of files whose path names the day.

    A corrupt file fails the job; with skip_corrupt it is left out, and corrupt_files() names it.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", day_pattern, 1).alias("day"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for day, raw in zip(batch["day"], batch["content"], strict=True):
                try:
                    rows = decode(bytes(raw), scale)
                except ValueError as e:
                    if not skip_corrupt:
                        raise ValueError(f"{day}: {e}") from e
                    continue
                yield rows.assign(day=day)[["day", "second", "open", "high", "low", "close", "volume"]]

    rows = files.mapInPandas(run, "day string, second long, open double, high double, low double, close double, volume double")
    at = F.timestamp_seconds(F.unix_timestamp(F.to_date("day")) + F.col("second")).cast("timestamp_ntz")
    return rows.select(F.to_date("day").alias("day"), at.alias("time"), "open", "high", "low", "close", "volume")


def corrupt_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path) of the files that can't be decompressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    decode(bytes(raw), 1.0)
                except ValueError:
                    bad.append(path)
            yield pd.DataFrame({"path": bad})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string")


def price_scale(raw_mean: float, reference: float, scales: tuple[float, ...] = (1.0, 10.0, 100.0, 1000.0, 1e4, 1e5)) -> float:
    """The divisor that brings raw prices nearest to a reference price, in logarithms."""
    return min(scales, key=lambda k: abs(math.log(raw_mean / k / reference)))


def mid_bars(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """(time, open, high, low, close, volume, spread): means of both sides, and the bid's volume.

    Only times that both sides have, with a trade or a move on either. The spread is the mean of those at open and close.
    """
    sides = bid.withColumn("side", F.lit("b")).unionByName(ask.withColumn("side", F.lit("a")))
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    prices = ("open", "high", "low", "close")
    rows = sides.groupBy("time").agg(F.count_distinct("side").alias("n"), *[of(c, s).alias(f"{s}_{c}") for c in (*prices, "volume") for s in "ab"])
    alive = F.greatest("a_volume", "b_volume", F.col("a_high") - F.col("a_low"), F.col("b_high") - F.col("b_low")) > 0
    gap = lambda c: F.col(f"a_{c}") - F.col(f"b_{c}")
    spread = F.greatest((gap("open") + gap("close")) / 2, F.lit(0.0))
    return rows.filter((F.col("n") == 2) & alive).select("time", *[((F.col(f"a_{c}") + F.col(f"b_{c}")) / 2).alias(c) for c in prices], F.col("b_volume").alias("volume"), spread.alias("spread"))
