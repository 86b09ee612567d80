"""Keyed state with timers: each reading beside the one before it, and keys that have gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id bigint, event_id bigint, ts timestamp, value double, previous double, kind string"
#: Buckets of users, which state lies by: fixed, since a run starts from the state of the one before.
BUCKETS = 512
#: Whom a reading is of (null being nobody), and what is held of one.
USER = ["user_id", "nobody"]
HELD = np.dtype([("user_id", "i8"), ("nobody", "i4"), ("event_id", "i8"), ("micros", "i8"), ("value", "f8")])


def _columns() -> list[str]:
    return [c.split()[0] for c in OUT.split(", ")]


class LastReading(StatefulProcessor):
    """Of each user the last reading in order of arrival (batch, time, event); forgotten when the user stays quiet.

    A key is a bucket of users, whose readings are taken as columns: a call of Python a user costs far
    more than its few readings. A reading that the watermark has passed is dropped. When the watermark reaches the
    last reading's time and `quiet_ms` more, a row of kind "quiet" is given and the user leaves the
    state, so that the store holds no more than the users that are active; a bucket has one timer, the earliest of its users'.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "users binary, timer bigint")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        held = self.last.get() if self.last.exists() else (b"", None)
        return pd.DataFrame(np.frombuffer(bytes(held[0]), HELD)), held[1]

    def _hold(self, users: pd.DataFrame, timer: int | None) -> None:
        """Store users, and move the bucket's timer; one fires when the watermark is past it, so that it is set a millisecond before."""
        ahead = int((users["micros"] // 1000).min()) + self.quiet_ms - 1 if len(users) else None
        if timer is not None and timer != ahead:
            self.handle.deleteTimer(timer)
        if ahead is None:
            self.last.clear()
            return
        self.last.update((users[list(HELD.names)].to_records(index=False, column_dtypes={n: HELD[n] for n in HELD.names}).tobytes(), ahead))
        if timer != ahead:
            self.handle.registerTimer(ahead)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch["micros"] = batch["ts"].astype("datetime64[us]").astype("int64")
        batch = batch[batch["micros"] // 1000 > timerValues.getCurrentWatermarkInMs()]
        if not len(batch):
            return
        held, timer = self._held()
        # Those held have arrived before.
        both = pd.concat([held.assign(new=False), batch.assign(new=True)]).sort_values([*USER, "new", "micros", "event_id"], ignore_index=True)
        users = both.groupby(USER, sort=False)
        both["previous"] = users["value"].shift(1)
        yield _out(both[both["new"]], "reading")
        self._hold(both[~both.duplicated(USER, keep="last")], timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        due = held["micros"] // 1000 + self.quiet_ms <= timerValues.getCurrentWatermarkInMs()
        self._hold(held[~due], None)
        if due.any():
            yield _out(held[due].assign(ts=pd.to_datetime(held["micros"], unit="us"), previous=np.nan), "quiet")

    def close(self) -> None:
        pass


def _out(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
    return rows.assign(user_id=rows["user_id"].astype("Int64").mask(rows["nobody"].astype(bool)), kind=kind)[_columns()]


def readings(events: DataFrame, late: str, quiet_ms: int) -> DataFrame:
    """OUT of a stream of (user_id, event_id, ts, value), with rows later than `late` dropped."""
    nobody = F.col("user_id").isNull().cast("int")
    timed = events.select(F.coalesce("user_id", F.lit(0)).alias("user_id"), nobody.alias("nobody"), "event_id", "ts", "value").withWatermark("ts", late)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64(*USER), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(LastReading(quiet_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def take_readings(spark: SparkSession, landed: str, schema: str, target: str, checkpoint: str, *, late: str, quiet_ms: int) -> StreamingQuery:
    """Append what has landed since the last run to `target`, and end; state and progress are in `checkpoint`, so a run that is lost is run again."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(schema).parquet(landed)
        sink = readings(stream, late, quiet_ms).writeStream.outputMode("append").format("parquet")
        return sink.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
