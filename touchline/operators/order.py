"""Ranks and order statistics of whole tables without gathering them in one task."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import stored

#: Bins of a histogram pass: all that the driver gets of it.
BINS = 2048


def ranked(df: DataFrame, order: dict[str, bool], name: str = "rank") -> DataFrame:
    """df with rank() by columns (True: falling), rows that are equal in all of them sharing the least.

    Rows of one key are counted together first, so that no number of ties comes to one
    task. The keys are sorted by range partitioning; their counts are summed up inside each partition, and
    the sum of the partitions before comes from a table of one row a partition. Nulls come first in
    a rising column and last in a falling one, as in a window.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    by = [F.desc(c) if falls else F.asc(c) for c, falls in order.items()]
    keys = df.groupBy(*order).agg(F.count("*").alias("__n")).repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    keys = stored(keys, "rank-keys")
    sums = {r["__part"]: r["n"] for r in keys.groupBy("__part").agg(F.sum("__n").alias("n")).collect()}
    starts, at = [], 0
    for part in sorted(sums):
        starts.append((part, at))
        at += sums[part]
    first = df.sparkSession.createDataFrame(starts, "__part int, __first long")
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = keys.withColumn("__before", inside).join(first, "__part").withColumn(name, F.col("__first") + F.col("__before") + 1)
    if set(df.columns) == set(order):
        # A key of several rows stands for each of them.
        return places.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*df.columns, name)
    places = places.select(*[F.col(c).alias(f"__k_{c}") for c in order], name)
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in order]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(places, on).select(*df.columns, name)


def nth_values(df: DataFrame, column: str, places: list[int]) -> list[int]:
    """The values at these places (from 0) in the order of a whole-number column; nulls are not counted.

    Each pass counts the rows of BINS ranges of what is left of the values; the range that holds
    the place is divided again, so that a table of n distinct values takes
    log(n) / log(BINS) passes and no task or driver ever holds more than a histogram.
    """
    values = df.select(F.col(column).cast("decimal(20,0)").alias("v"))
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if any(not 0 <= p < ends["n"] for p in places):
        raise ValueError(f"places must be from 0 to below {ends['n']}")
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = []
    for place in places:
        lo, hi, below = int(ends["lo"]), int(ends["hi"]), 0
        while lo < hi:
            step = -(-(hi - lo + 1) // BINS)
            if (lo, hi) not in seen:
                inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(F.expr(f"(v - {lo}BD) div {step}BD").alias("b")).agg(F.count("*").alias("n"))
                seen[lo, hi] = sorted((r["b"], r["n"]) for r in inside.collect())
            for b, n in seen[lo, hi]:
                if below + n > place:
                    break
                below += n
            lo, hi = lo + b * step, min(hi, lo + (b + 1) * step - 1)
        out.append(lo)
    return out


def quantile(df: DataFrame, column: str, part: float) -> float | None:
    """The exact quantile of a whole-number column, between two neighbours in proportion; None where it has no value."""
    n = df.agg(F.count(column)).first()[0]
    if not n:
        return None
    at = (n - 1) * part
    low = floor(at)
    a, b = nth_values(df, column, [low, min(low + 1, n - 1)])
    return a + (b - a) * (at - low)
