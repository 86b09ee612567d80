"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter exits
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder that all executors share, under spark.checkpoint.dir where that is set; deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def bucketed(df: DataFrame, what: str, keys: tuple[str, ...], buckets: int) -> str:
    """The name of a table that df is written to in so many buckets by keys, a file each: tables of as many buckets by the same keys join by them, and aggregate by them and more, where they lie."""
    spark, name = df.sparkSession, f"{what.replace('-', '_')}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch(spark, what)).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return name


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # as in forget
        pass


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once and read back: plans that use it several times, or after an executor is lost, do not derive it anew."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
