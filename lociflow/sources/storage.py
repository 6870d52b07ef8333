"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors see.

    Where that setting is empty and the master is one machine (tests) a folder of its own is set for the
    session; on a cluster that is an error, as executors would not see it. All of an application's folders lie in one, which goes
    when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="lociflow-")
        spark.sparkContext.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/lociflow-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables from `written` that nothing will read again; others are left alone."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
