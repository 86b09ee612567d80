"""Bonus allocation over ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rules import BONUS


def award(rank: Column) -> Column:
    """Bonus for a rank that leaves gaps after ties: those ahead have used up that many awards."""
    return F.greatest(F.lit(0), F.lit(len(BONUS) + 1) - rank)


def allocate_bonus(scores: DataFrame, *, fixture: str | list[str] = "fixture", bps: str = "bps") -> DataFrame:
    """scores plus bonus: per fixture 3, 2, 1 by falling score; ties share, and use up an award each."""
    keys = [fixture] if isinstance(fixture, str) else fixture
    return scores.withColumn("bonus", award(F.rank().over(W.partitionBy(*keys).orderBy(F.desc(bps)))).cast("int"))


def bonus_from_fixture_stats(fixture_stats: DataFrame) -> DataFrame:
    """(fixture, element, bps, bonus) from flattened fixture statistics (fixture, identifier, side, element, value)."""
    scores = fixture_stats.where("identifier = 'bps'").select("fixture", "element", F.col("value").cast("int").alias("bps"))
    return allocate_bonus(scores)
