"""Tables in the shared folder: what must not be computed twice."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own in local mode only."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.attestry.dir", None)
    if path is None:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="attestry-")
        spark.conf.set("spark.attestry.dir", path)
    return path


def remover(spark: SparkSession, path: str):
    """Deletes a folder when the driver's Python ends. The file system is taken now, so
    that it works after spark.stop() too, as long as the gateway lives."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def remove() -> None:
        try:
            files.delete(hadoop, True)
        except Exception:  # the gateway is gone
            pass

    return remove


def once(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: whatever uses it, it is
    computed once, and a lost executor costs no new call of a service."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/attestry-{uuid.uuid4().hex}"
    atexit.register(remover(spark, folder))
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")
