"""Tables written to the shared folder, to cut long plans."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's checkpoint folder, which driver and executors share. Where
    neither is set, a session on this machine alone gets one of our own; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/assay"
        spark.sparkContext.setCheckpointDir(at)
        return at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the driver's JVM may be gone already
        return


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: later steps neither repeat its work nor depend on executors.
    Row groups are small, as each task holds one in memory."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
