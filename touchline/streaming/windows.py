"""Event-time windows with watermarks, alike for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tumbling(events: DataFrame, width: str, keys: list[str], *, ts: str = "ts", late: str | None = None, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """(window_start, keys, aggregates) by windows of a width, sliding if slide is given; rows later than `late` are dropped from a stream."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, width, slide), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("window_start"), *keys, *aggregates)


def sessions(events: DataFrame, gap: str, keys: list[str], *, ts: str = "ts", late: str | None = None, **aggregates: Column) -> DataFrame:
    """(session_start, session_end, keys, aggregates) of events no further apart than gap."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggregates)


def first_seen(events: DataFrame, keys: list[str], late: str, *, ts: str = "ts") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what has landed into a memory table, and read that."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
