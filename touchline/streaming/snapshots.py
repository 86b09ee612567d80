"""Polled snapshots as a stream: appended once, the last reading of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.monitor import deduplicate


def append_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """Write a micro-batch to a folder of its own; a batch that runs again overwrites itself."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, file_format: str = "parquet"):
    """A query that takes all landed files and ends; run it as often as files are polled."""
    stream = spark.readStream.format(file_format).schema(schema).load(source)
    sink = stream.writeStream.foreachBatch(lambda df, n: append_batch(df, n, target))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, target: str, keys: tuple[str, ...] = ("ts", "player_id")) -> DataFrame:
    """All snapshots, of each key the row of the last batch."""
    return deduplicate(spark.read.option("basePath", target).parquet(target), list(keys), [F.col("batch")]).drop("batch")
