"""Tables between the steps of one job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="chronosift-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Steps:
    """Writes frames as Parquet and reads them back, which cuts their lineage; clear() deletes what isn't kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def put(self, df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
        folder = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        if not keep:
            self.folders.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while self.folders:
            path = jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(conf).delete(path, True)
