"""Rows that no other row of their group beats: a distributed skyline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import stored

#: Rows of a cell, which is what a task holds of a group at a time, and ranges of a group's first dimension.
CELL, RANGES = 4096, 64
#: Rows compared at a time.
BLOCK = 256


def beaten(rows: np.ndarray, ties: np.ndarray, by: np.ndarray, by_ties: np.ndarray) -> np.ndarray:
    """How many of the others are no smaller than a row in any dimension, and greater in one or in the tie."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(0, len(rows), BLOCK):
        part, tie = rows[lo : lo + BLOCK], ties[lo : lo + BLOCK]
        for at in range(0, len(by), 4 * BLOCK):
            other = by[at : at + 4 * BLOCK]
            no_less, more = np.ones((len(part), len(other)), bool), by_ties[None, at : at + 4 * BLOCK] > tie[:, None]
            for d in range(rows.shape[1]):
                no_less &= other[None, :, d] >= part[:, None, d]
                more |= other[None, :, d] > part[:, None, d]
            out[lo : lo + BLOCK] += np.count_nonzero(no_less & more, axis=1)
    return out


def best_of(rows: np.ndarray, ties: np.ndarray, most: int = 1) -> np.ndarray:
    """Places of the rows that fewer than `most` others beat.

    In falling lexicographic order a row can only be beaten by one before it, so that each
    block is compared with what is left of the blocks before, and with itself. What is left is enough: of the
    rows that beat one, the first `most` in that order are left.
    """
    order = np.lexsort((-ties, *(-rows[:, d] for d in reversed(range(rows.shape[1])))))
    held = np.empty(0, np.int64)
    for lo in range(0, len(order), BLOCK):
        part = order[lo : lo + BLOCK]
        n = beaten(rows[part], ties[part], rows[held], ties[held])
        part, n = part[n < most], n[n < most]
        held = np.concatenate([held, part[n + beaten(rows[part], ties[part], rows[part], ties[part]) < most]])
    return np.sort(held)


def skyline(df: DataFrame, keys: list[str], maximise: list[Column], ids: list[str], *, most: int = 1, tie: Column | None = None) -> DataFrame:
    """(ids) of the rows that no row of the same keys beats, or fewer than `most` do; ids tell the rows apart.

    A row beats another if it is no smaller in any of the columns to maximise and
    greater in one; of equal rows that with the greater tie beats the other, none without a tie. (1) Each group is cut into ranges of the first column by
    quantiles, and ranges into cells of about CELL rows, hashed within; each cell keeps its own best. As long as that
    leaves less than half, the rest is cut anew, so that all rounds together read no more than twice the rows. (2) Cells are
    compared pair by pair, but only where the greatest corner of one
    reaches the least corner of the other in every column, which rules out most ranges
    that are lower. A task holds two cells; no pair of rows leaves it, only how many beat a row.

    Null and NaN values are smaller than all others. Null keys are a group. No rows: no rows.
    """
    number = lambda c: F.when(F.isnan(c) | c.isNull(), F.lit(float("-inf"))).otherwise(c)
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = stored(df.select(group.alias("g"), *ids, F.array(*[number(c.cast("double")) for c in maximise]).alias("x"), (F.lit(0.0) if tie is None else tie.cast("double")).alias("t")), "skyline")
    kind = rows.select("g", *ids, "x", "t").schema
    with_cell = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", cell string"
    own = ["g", *ids, "x", "t"]

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[best_of(np.stack(g["x"].to_numpy()).astype(np.float64), g["t"].to_numpy(float), most)]

    n = rows.count()
    while True:
        at = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
        sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx(F.col("x")[0], at, F.lit(1000)).alias("edges"))
        large = F.col("n") > CELL
        place = F.when(large, F.size(F.filter("edges", lambda e: e < F.col("x")[0]))).otherwise(0)
        parts = F.when(large, F.ceil(F.col("n") / (CELL * RANGES))).otherwise(1)
        cut = rows.join(sizes, "g").withColumn("cell", F.concat_ws("/", place.cast("string"), F.pmod(F.xxhash64(*ids), parts).cast("string"), F.ceil(parts).cast("string")))
        rows = stored(cut.select(*own, "cell").groupBy("g", "cell").applyInPandas(keep, with_cell), "skyline")
        left, cells = rows.agg(F.count("*"), F.count_distinct("g", "cell") - F.count_distinct("g")).first()
        if not cells:
            return rows.select(*ids)
        if left * 2 > n:
            break
        rows, n = rows.select(*own), left

    dims = range(len(maximise))
    corner = lambda f, name: F.array(*[f(F.col("x")[d]) for d in dims]).alias(name)
    corners = stored(rows.groupBy("g", "cell").agg(corner(F.min, "low"), corner(F.max, "high")), "skyline-cells")
    other = corners.select("g", F.col("cell").alias("by"), F.col("high").alias("top"))
    reach = F.forall(F.zip_with("top", "low", lambda h, lo: h >= lo), lambda b: b)
    # Where several may beat a row, those of its own cell count too.
    pairs = stored(corners.join(other, "g").where(reach if most > 1 else (F.col("cell") != F.col("by")) & reach).select("g", "cell", "by"), "skyline-pairs")
    losers = rows.join(pairs, ["g", "cell"])
    winners = pairs.join(rows.select("g", F.col("cell").alias("by"), "x", "t"), ["g", "by"]).select(F.col("g").alias("of_g"), F.col("cell").alias("of"), F.col("by").alias("from"), F.col("x").alias("y"), F.col("t").alias("u"))

    def lost(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(c):
            return t.iloc[:0][ids].assign(n=0)
        whole = lambda x: np.stack(x.to_numpy()).astype(np.float64)
        n = beaten(whole(t["x"]), t["t"].to_numpy(float), whole(c["y"]), c["u"].to_numpy(float))
        return t[ids].assign(n=n)[n > 0]

    of_ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind if f.name in ids)
    gone = losers.groupBy("g", "cell", "by").cogroup(winners.groupBy("of_g", "of", "from")).applyInPandas(lost, f"{of_ids}, `n` bigint").groupBy(*ids).agg(F.sum("n").alias("n")).where(F.col("n") >= most)
    return rows.select(*ids).join(gone, ids, "left_anti")
