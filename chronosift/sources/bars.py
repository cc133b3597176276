"""Reading, normalising, validating, hashing and writing bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.resample import BAR_COLUMNS


def make_bars(df: DataFrame, width: str, *, default_spread: float | None = None) -> DataFrame:
    """Adds volume, spread and available_at where they lack; columns in canonical order."""
    out = df if "series_id" in df.columns else df.withColumn("series_id", F.lit(0).cast("long"))
    if "volume" not in out.columns:
        out = out.withColumn("volume", F.lit(0.0))
    if "spread" not in out.columns:
        if default_spread is None:
            raise ValueError("bars have no spread and there is no default")
        out = out.withColumn("spread", F.lit(default_spread))
    if "available_at" not in out.columns:
        out = out.withColumn("available_at", F.col("time") + F.expr(f"INTERVAL {width}"))
    return out.select(*BAR_COLUMNS)


def normalise(df: DataFrame, width: str, *, default_spread: float | None = None, seq: str | None = None) -> DataFrame:
    """Drops rows without time or with prices that aren't positive; keeps the last of equal times."""
    out = df if "series_id" in df.columns else df.withColumn("series_id", F.lit(0).cast("long"))
    cols = [c for c in out.columns if c != seq]
    row = F.struct(*cols)
    last = out.filter("time IS NOT NULL").groupBy("series_id", "time").agg(F.max_by(row, F.col(seq) if seq else F.xxhash64(*cols)).alias("r")).select("r.*")
    good = last.filter("open > 0 AND high > 0 AND low > 0 AND close > 0")
    if "volume" in cols:
        good = good.withColumn("volume", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)))
    if "spread" in cols:
        good = good.withColumn("spread", F.greatest(F.coalesce(F.col("spread"), F.lit(default_spread)), F.lit(0.0)))
    return make_bars(good, width, default_spread=default_spread)


def rule_counts(bars: DataFrame) -> DataFrame:
    """One row: how many bars break each rule of the schema."""
    bad = {
        "bad_price": ~F.expr("open > 0 AND high > 0 AND low > 0 AND close > 0"),
        "bad_high": F.col("high") < F.greatest("open", "close", "low") * (1 - 1e-9),
        "bad_low": F.col("low") > F.least("open", "close", "high") * (1 + 1e-9),
        "bad_volume": ~(F.col("volume") >= 0),
        "bad_spread": ~(F.col("spread") >= 0),
        "bad_available": F.col("available_at") <= F.col("time"),
    }
    return bars.agg(F.count(F.lit(1)).alias("n_bars"), *[F.count_if(c).alias(n) for n, c in bad.items()])


def validate(bars: DataFrame) -> DataFrame:
    """bars, or ValueError with the counts of the rules they break."""
    found = {k: v for k, v in rule_counts(bars).head().asDict().items() if k != "n_bars" and v}
    if found:
        raise ValueError(f"bars break the schema: {found}")
    return bars


def content_hash(df: DataFrame, order: tuple[str, ...] = ("series_id", "time"), block: int = 4096) -> str:
    """SHA-256 of the rows in their order: of blocks first, then of the blocks' hashes.

    A block holds the rows of one series and of as many periods of 2^38 microseconds (three days) as `block` / 4096;
    only blocks are gathered in one place, as 64 characters each.
    """
    keys = [c for c in order if c in df.columns]
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    by_time = (F.unix_micros(F.col("time").cast("timestamp")) / (2.0**38 * block / 4096)).cast("long") if "time" in keys else F.lit(0)
    rows = df.select(F.struct(*[F.col(c) for c in keys], F.sha2(line, 256).alias("h")).alias("r"), *[F.col(c).alias(f"__{c}") for c in keys if c != "time"], by_time.alias("__b"))
    groups = [c for c in rows.columns if c != "r"]
    blocks = rows.groupBy(*groups).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["h"]), ","), 256).alias("h"))
    whole = blocks.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*groups, "h"))), lambda b: b["h"]), ","), 256).alias("h"))
    return whole.head()["h"]


def save_bars(bars: DataFrame, path: str) -> dict:
    """Writes validated bars by series and returns the manifest."""
    validate(bars).write.mode("overwrite").option("compression", "zstd").partitionBy("series_id").parquet(path)
    m = bars.agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("start"), F.max("time").alias("end")).head().asDict()
    return m | {"content_hash": content_hash(bars.select(*BAR_COLUMNS))}


def load_bars(spark: SparkSession, path: str, *, content: str | None = None) -> DataFrame:
    bars = spark.read.parquet(path).withColumn("series_id", F.col("series_id").cast("long")).select(*BAR_COLUMNS)
    if content is not None and content_hash(bars) != content:
        raise ValueError("the stored bars differ from their manifest")
    return bars


def load_csv(spark: SparkSession, path: str, width: str, *, tz: str = "UTC", default_spread: float | None = None) -> DataFrame:
    """A CSV file with a header time, open, high, low, close[, volume][, spread] in any case."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    cols = [F.to_utc_timestamp(F.to_timestamp("time"), tz).cast("timestamp_ntz").alias("time")]
    cols += [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close", "volume", "spread") if c in raw.columns]
    return normalise(raw.select(*cols), width, default_spread=default_spread)


def load_terminal_csv(spark: SparkSession, path: str, width: str, *, point: float, server_tz: str = "UTC", sep: str = "\t", encoding: str = "UTF-8", default_spread: float = 0.0) -> DataFrame:
    """A trading terminal's export: <DATE> <TIME> <OPEN> .. <TICKVOL> <VOL> <SPREAD>; spread in points."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    raw = raw.toDF(*[c.strip("<> ﻿").lower() for c in raw.columns])
    at = F.concat_ws(" ", F.replace("date", F.lit("."), F.lit("-")), F.col("time") if "time" in raw.columns else F.lit("00:00:00"))
    spread = F.expr("try_cast(spread AS DOUBLE)") * point if "spread" in raw.columns else F.lit(default_spread)
    prices = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close")]
    volume = F.expr("try_cast(tickvol AS DOUBLE)") if "tickvol" in raw.columns else F.lit(0.0)
    rows = raw.select(F.to_utc_timestamp(F.to_timestamp(at), server_tz).cast("timestamp_ntz").alias("time"), *prices, volume.alias("volume"), spread.alias("spread"))
    return normalise(rows, width, default_spread=default_spread)
