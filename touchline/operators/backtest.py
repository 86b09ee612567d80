"""Calibration, errors and baselines of past predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scoring


def rescore(history: DataFrame) -> DataFrame:
    """(season, gw, element, actual): history scored by today's rules, matches of a gameweek summed."""
    return scoring.gameweek_points(history.where("position is not null"), ["season", "gw", "element"]).withColumnRenamed("points", "actual")


def calibration(predictions: DataFrame, quantiles: tuple[str, ...] = ("p10", "p25", "p50", "p75", "p90")) -> DataFrame:
    """(quantile, nominal, coverage) over rows with these columns and actual, and the bands between the outer pairs."""
    long = predictions.unpivot(["actual"], list(quantiles), "quantile", "value")
    single = long.groupBy("quantile").agg(F.avg((F.col("actual") <= F.col("value")).cast("double")).alias("coverage"))
    single = single.withColumn("nominal", F.regexp_replace("quantile", "p", "").cast("double") / 100.0)
    out = single.select("quantile", "nominal", "coverage")
    for lo, hi in zip(quantiles[: len(quantiles) // 2], reversed(quantiles)):
        inside = F.avg(F.col("actual").between(F.col(lo), F.col(hi)).cast("double"))
        band = predictions.agg(inside.alias("coverage")).select(F.lit(f"{lo}-{hi}").alias("quantile"), F.lit((int(hi[1:]) - int(lo[1:])) / 100.0).alias("nominal"), "coverage")
        out = out.unionByName(band)
    return out


def errors(rows: DataFrame, predicted: str, actual: str = "actual", keys: list[str] | None = None) -> DataFrame:
    """rmse, mae and n."""
    d = F.col(predicted) - F.col(actual)
    return rows.groupBy(*(keys or [])).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(d).alias("n"))


def season_mean_baseline(actuals: DataFrame, targets: DataFrame, key: str = "element") -> DataFrame:
    """(season, gw, key, baseline): the mean of the season's earlier gameweeks, else that of the season before.

    targets: season, gw. key should be one that lasts over seasons, as ids do not. A player's gameweeks of a
    season, no more than the game has, are gathered once and each target sums those before it; no rows are paired.
    """
    seasons = actuals.select("season").distinct().withColumn("n", F.dense_rank().over(W.orderBy("season")))
    by_week = actuals.groupBy("season", key, "gw").agg(F.sum(F.col("actual").cast("double")).alias("s"), F.count("actual").alias("c"))
    played = by_week.groupBy("season", key).agg(F.collect_list(F.struct("gw", "s", "c")).alias("weeks"), F.sum("s").alias("__s"), F.sum("c").alias("__c"))
    whole = played.join(seasons, "season").select((F.col("n") + 1).alias("n"), key, F.try_divide("__s", "__c").alias("last"))
    now = targets.join(seasons, "season")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"))
    before = F.aggregate(F.filter("weeks", lambda x: x["gw"] < F.col("gw")), zero, lambda acc, x: F.struct((acc["s"] + F.coalesce(x["s"], F.lit(0.0))).alias("s"), (acc["c"] + x["c"]).alias("c")))
    early = (
        played.select("season", key, "weeks").join(now, "season").where(F.exists("weeks", lambda x: x["gw"] < F.col("gw")))
        .withColumn("__b", before).select("season", "gw", key, F.try_divide("__b.s", "__b.c").alias("baseline"))
    )
    first = now.join(early.select("season", "gw").distinct(), ["season", "gw"], "left_anti").join(whole, "n").select("season", "gw", key, F.col("last").alias("baseline"))
    return early.unionByName(first)


def recent_gameweeks(rows: DataFrame, window: int) -> DataFrame:
    """rows of the last `window` gameweeks (gw) that have any."""
    last = rows.where("gw is not null").select("gw").distinct().orderBy(F.desc("gw")).limit(window)
    return rows.join(last, "gw", "left_semi")


def compare(predictions: DataFrame, actuals: DataFrame, baseline: DataFrame, key: str = "element", relevant: float = 0.0) -> DataFrame:
    """(model, rmse, mae, n) of the model and the baseline over players whose prediction, outcome or baseline exceeds `relevant`; absent outcomes are 0."""
    on = ["season", "gw", key]
    rows = predictions.select(*on, "ep").join(actuals.select(*on, "actual"), on, "left").join(baseline, on, "left").na.fill(0.0, ["baseline"]).na.fill(0, ["actual"])
    kept = rows.where((F.col("ep") > relevant) | (F.col("actual") > relevant) | (F.col("baseline") > relevant))
    return kept.unpivot([*on, "actual"], ["ep", "baseline"], "model", "value").groupBy("model").agg(
        F.sqrt(F.avg(F.pow(F.col("value") - F.col("actual"), 2))).alias("rmse"), F.avg(F.abs(F.col("value") - F.col("actual"))).alias("mae"), F.count("*").alias("n")
    )
