"""Agreement of recomputed points and bonus with published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from .bonus import allocate_bonus


def rebuilt_points(explain: DataFrame, live: DataFrame) -> DataFrame:
    """(gw, element, total_points, rebuilt): published totals beside the sums of their lines (points + modification)."""
    lines = explain.groupBy("gw", "element").agg(F.sum(F.col("points") + F.coalesce("points_modification", F.lit(0))).alias("rebuilt"))
    return live.select("gw", "element", "total_points").join(lines, ["gw", "element"], "left").withColumn("rebuilt", F.coalesce("rebuilt", F.lit(0)))


def reconcile_points(stat_lines: DataFrame, published: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Per row of keys: engine and published totals, and whether both and every line (identifier, points) agree.

    Lines are summed as columns by keys on either side, before anything is shuffled. A line that
    one side lacks counts as 0; a published line of a name that the rules do not know agrees only if it is worth nothing.
    """
    mine, names = scoring.term_sums(stat_lines, keys, position)
    known, worth = F.coalesce(F.col("identifier").isin(names), F.lit(False)), F.col("points") + F.coalesce("points_modification", F.lit(0))
    theirs = published.select(*keys, "identifier", worth.cast("bigint").alias("__p")).groupBy(*keys).agg(
        F.sum("__p").alias("published"), F.coalesce(F.bool_and(known | (F.col("__p") == 0)), F.lit(True)).alias("__known"), *[F.sum(F.when(F.col("identifier") == n, F.col("__p"))).alias(f"t_{n}") for n in names]
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    shown = F.exists(F.array(*[F.col(f"n_{n}") for n in names]), lambda n: n > 0) | F.col("published").isNotNull()
    total, same = F.lit(0).cast("bigint"), F.coalesce("__known", F.lit(True))
    for n in names:
        total, same = total + zero(f"s_{n}"), same & (zero(f"s_{n}") == zero(f"t_{n}"))
    both = mine.join(theirs, keys, "full_outer").where(shown)
    return both.select(*keys, total.alias("engine"), zero("published").alias("published"), same.alias("agrees"))


def reconcile_bonus(scores: DataFrame, published: DataFrame) -> DataFrame:
    """Per fixture: players and whether allocated bonus is the published (fixture, element, bonus), absent being 0.

    A fixture's published bonus is one list, of no more than its players, so that both meet by fixture, where the ranks lie.
    """
    given = published.groupBy("fixture").agg(F.collect_list(F.struct("element", "bonus")).alias("all"))
    own = F.filter("all", lambda g: g["element"] == F.col("element"))
    both = allocate_bonus(scores).join(given, "fixture", "left").withColumn("own", F.explode_outer(own)).withColumn("given", F.coalesce("own.bonus", F.lit(0)))
    return both.groupBy("fixture").agg(F.count("*").alias("players"), F.bool_and(F.col("bonus") == F.col("given")).alias("agrees"))


def reconcile_rosters(elements: DataFrame) -> DataFrame:
    """Per fixture: players and whether allocated bonus is the published one, over whole rosters of live documents.

    elements: id, minutes, bps and explain (a list of fixtures with their bonus). Fixture
    statistics leave out who scored 0; here everyone with minutes stands in each of their fixtures.
    """
    rows = elements.where("minutes > 0").select(F.col("id").alias("element"), "bps", F.explode("explain").alias("x")).select("x.fixture", "element", "bps", F.col("x.bonus").alias("given"))
    return allocate_bonus(rows).groupBy("fixture").agg(F.count("*").alias("players"), F.bool_and(F.col("bonus") == F.coalesce("given", F.lit(0))).alias("agrees"))
