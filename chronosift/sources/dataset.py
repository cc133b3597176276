"""A data set of bars of several sizes from cached candle files, with a manifest; and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.operators.quality import spread_report
from chronosift.operators.resample import BAR_COLUMNS, resample_bars
from chronosift.sources.bars import content_hash, make_bars
from chronosift.sources.candles import mid_bars, read_candles

#: Name, width and shift of each size; the last one is a day that closes at 17 h in New York's winter.
SIZES = (("M15", "15 minutes", "0 hours"), ("H1", "1 hour", "0 hours"), ("H4", "4 hours", "2 hours"), ("D1", "1 day", "0 hours"), ("D1_nyclose", "1 day", "22 hours"))


def build(spark: SparkSession, bid: str, ask: str, out: str, *, scale: float, series_id: int = 0, sizes=SIZES) -> dict:
    """Minute bars of both sides as mid bars, coarser ones from them, each stored; returns the manifest."""
    minute = make_bars(mid_bars(read_candles(spark, bid, scale=scale).drop("day"), read_candles(spark, ask, scale=scale).drop("day")).withColumn("series_id", F.lit(series_id).cast("long")), "1 minute")
    minute.write.mode("overwrite").parquet(f"{out}/M1")
    minute = spark.read.parquet(f"{out}/M1")
    manifest: dict = {"M1": _entry(minute)}
    for name, width, shift in sizes:
        resample_bars(minute, width, base_width="1 minute", shift=shift).write.mode("overwrite").parquet(f"{out}/{name}")
        manifest[name] = _entry(spark.read.parquet(f"{out}/{name}"))
    manifest["quality"] = spread_report(spark.read.parquet(f"{out}/{sizes[0][0]}")).head().asDict()
    save_json(spark, [manifest], f"{out}/manifest")
    return manifest


def _entry(bars: DataFrame) -> dict:
    r = bars.agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("start"), F.max("time").alias("end")).head().asDict()
    return r | {"content_hash": content_hash(bars.select(*BAR_COLUMNS))}


def cached_since(days: DataFrame, end: str) -> DataFrame:
    """One row (since): the first of the weekdays that are all in `days` (date) up to the end; null if the end isn't."""
    have = days.filter((F.weekday("date") < 5) & (F.col("date") <= F.lit(end).cast("date"))).select("date").distinct()
    # weekdays are numbered without weekends, so a gap shows as a jump
    number = F.floor(F.datediff("date", F.lit("1970-01-05").cast("date")) / 7) * 5 + F.weekday("date")
    w = Window.orderBy(F.desc("date"))
    rows = have.withColumn("k", number).withColumn("g", F.col("k") + F.row_number().over(w))
    last = F.date_sub(F.lit(end).cast("date"), F.greatest(F.weekday(F.lit(end).cast("date")) - 4, F.lit(0)))
    top = rows.agg(F.max_by("g", "date").alias("top"), F.max("date").alias("newest"))
    return rows.join(F.broadcast(top), F.col("g") == F.col("top")).agg(F.min(F.when(F.col("newest") == last, F.col("date"))).alias("since"))


def save_frame(df: DataFrame, path: str, metadata: dict | None = None) -> dict:
    """A compressed Parquet table and its metadata beside it, with rows and content hash."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    meta = (metadata or {}) | {"rows": stored.count(), "content_hash": content_hash(stored)}
    save_json(df.sparkSession, [meta], f"{path.rstrip('/')}.meta")
    return meta


def load_frame(spark: SparkSession, path: str, *, verify: bool = True) -> tuple[DataFrame, dict]:
    """A stored table and its metadata; ValueError if the rows aren't those that were stored."""
    df, meta = spark.read.parquet(path), json.loads(spark.read.text(f"{path.rstrip('/')}.meta").head()[0])
    if verify and content_hash(df) != meta["content_hash"]:
        raise ValueError(f"{path} differs from its metadata")
    return df, meta


def save_json(spark: SparkSession, records: list[dict], path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines."""
    rows = [(json.dumps(r, sort_keys=True, default=str),) for r in records]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode(mode).text(path)


def append_json(spark: SparkSession, record: dict, path: str) -> None:
    save_json(spark, [record], path, "append")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; a torn or foreign line is left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("v"))
    return rows.filter("v IS NOT NULL AND r IS NOT NULL").select("r.*")
