"""Helpers that the training-data operators share: tables, scratch data, distributed ranks."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window task ranks, and chunks whose totals one window task adds up.
CHUNK_ROWS = 500
TOTALS = 4096
#: Bytes of text that a Python worker takes in hand at a time, but for a single longer text.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A local folder of our own is used only where the session names none and runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="chronosift-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(df: DataFrame, name: str = "scratch") -> DataFrame:
    """Writes df to a table in the shared folder and reads it again.

    This cuts the lineage: whatever reads the result survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """The scratch tables of one job, to be deleted when it needs them no more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, name: str, *, keep: bool = False, group_rows: int | None = None) -> DataFrame:
        """A table that drop() deletes, unless it is to be kept for the result.

        group_rows: rows of a row group, for tables of very large rows, as a reader holds a group's rows at a time.
        """
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in self.paths:
            place = hadoop.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def small_batches(batches: Iterator, column: str, most: int = BATCH_BYTES) -> Iterator:
    """Arrow batches cut into slices with at most so many bytes of a text column, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(sizes + 1, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


#: Bytes of words: digits, letters with A-Z lowered, and all bytes of code points beyond ASCII; 0 for what separates words.
_WORD_BYTES = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)


def cut_words(texts) -> tuple:
    """The words of a string array's rows, as one Arrow array of bytes, and the number of words of each row (null: none).

    Words are maximal runs of ASCII letters, digits and code points beyond ASCII; only A-Z are lowered.
    Arrays from small_batches stay within a few bytes of work for each byte of text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    said = texts.buffers()[2]
    low = _WORD_BYTES[np.frombuffer(said, np.uint8)[at[0] : at[-1]]] if said is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[1:] > at[:-1]] - at[0]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    before = np.concatenate((np.cumsum(inside)[starts] - 1, [np.count_nonzero(inside)])).astype(np.int32) if len(starts) else np.zeros(1, np.int32)
    counts = np.diff(np.searchsorted(starts, at - at[0]))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(before), pa.py_buffer(np.ascontiguousarray(low[inside]))]), counts


def written_order(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """docs with their position (from 0) in the order of the files they are read from, and their number."""
    spark = docs.sparkSession
    if not docs.inputFiles():
        docs = scratch(docs, "ordered")
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    files = sorted(tuple(r) for r in docs.select(part.alias("part"), F.col("_metadata.file_name").alias("file")).groupBy("part", "file").count().collect())
    starts, n = [], 0
    for _, file, count in files:
        starts.append((file, n))
        n += count
    begin = small_frame(spark, starts or [("", 0)], "__file string, __begin long")
    rows = docs.select(*docs.columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return rows.join(F.broadcast(begin), "__file").select(*docs.columns, (F.col("__begin") + F.col("__index")).alias(name)), n


def set_aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but those used under names that no operator works with, and what these stand for."""
    aside = {f"aside {i}": c for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed({c: k for k, c in aside.items()}), aside


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of driver rows whose number a parameter bounds."""
    names = [x.split()[0] for x in schema.split(",")]
    said = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ",".join(f"{x.split()[0]}:{x.split()[1]}" for x in schema.split(","))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{fields}>>")))


def running(totals: DataFrame, keys: list[str], at: str, sums: dict[str, str], cut: int = TOTALS) -> DataFrame:
    """keys, at and, for each column of sums, its sum over smaller `at` of the same keys, under the new name.

    totals has one row a (keys, at). Runs of `cut` values of `at` are added up by tasks of their own, and
    a window over the runs' sums carries on from one to the next.
    """
    run = F.floor(F.col(at) / cut)
    own = Window.partitionBy(*keys, "__run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("__run", run)
    carried = rows.groupBy(*keys, "__run").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums]).select(*keys, "__run", *[F.coalesce(F.sum(f"__t_{c}").over(runs), F.lit(0)).alias(f"__c_{c}") for c in sums])
    within = rows.select(*keys, at, "__run", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"__w_{c}") for c in sums])
    return within.join(carried, [*keys, "__run"]).select(*keys, at, *[(F.col(f"__w_{c}") + F.col(f"__c_{c}")).alias(name) for c, name in sums.items()])


def rank_within(df: DataFrame, group: str, by: list[str], counts: list[tuple], *, weight: str | None = None, rank: str = "rank", before: str = "weight_before", key_type: str = "string", along: str | None = None, upto: int = 1, totals: int = TOTALS) -> DataFrame:
    """Adds each row's gapless rank (from 0) within its group and, for a weight, the weight before it.

    counts has (group, rows) pairs, as many as there are groups, which must be bounded.
    A group is cut into hash chunks of about CHUNK_ROWS rows, so that a group with a third of
    all rows is ranked by many tasks; prefix sums over chunk totals join the chunks up, in runs of
    `totals` chunks where there are more.
    The order is by chunk, then `by`. The group must not be null. along: a column from 0 to below upto
    that cuts the chunks by range instead of by hash; with it first in `by`, ranks follow it.
    """
    spark = df.sparkSession
    chunks = [(g, max(1, -(-n // CHUNK_ROWS))) for g, n in counts]
    cut = small_frame(spark, chunks, f"{group} {key_type}, __chunks long")
    cols = df.columns
    chunk = F.floor(F.col(along) * F.col("__chunks") / max(1, upto)) if along else F.pmod(F.xxhash64(*by), F.col("__chunks"))
    dealt = df.join(F.broadcast(cut), group).withColumn("__chunk", chunk.cast("long")).drop("__chunks")
    whole = Window.partitionBy(group, "__chunk").orderBy(*by)
    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(weight).alias("__w")] if weight else [])
    of_chunks = dealt.groupBy(group, "__chunk").agg(*sums)
    named = {"__n": "__n0"} | ({"__w": "__w0"} if weight else {})
    if max((n for _, n in chunks), default=1) > totals:
        offset = running(of_chunks, [group], "__chunk", named, totals)
    else:
        earlier = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        offset = of_chunks.select(group, "__chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in named.items()])
    out = dealt.withColumn("__r", F.row_number().over(whole))
    if weight:
        out = out.withColumn("__s", F.coalesce(F.sum(weight).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(offset, [group, "__chunk"])
    new = [(F.col("__n0") + F.col("__r") - 1).cast("long").alias(rank)]
    if weight:
        new.append((F.col("__w0") + F.col("__s")).cast("long").alias(before))
    return out.select(*cols, *new)
