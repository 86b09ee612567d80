"""League tables that lie by manager: the same results as derived tables, without exchanges of picks."""

import os
import re

import pytest

from pyspark.sql import functions as F

from touchline.operators import league, rates, reconcile
from touchline.plans import registry, star

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def no_broadcast(spark):
    """Joins that are not broadcast by a hint have to be by sorting, as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    """The expressions that rows are shuffled by, in the plan before it runs."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_scores_and_totals_do_not_exchange_picks(spark, no_broadcast):
    s = registry.Star(spark, SF)
    scores = league.gameweek_scores(registry._settled(s), s.live)
    totals = league.verify_totals(s.standings, scores, s.manager_gw)
    keys = lambda df: sorted(re.sub(r"#\d+L?", "", e) for e in exchanges(df))
    # The few gameweeks; for the totals, also sums of each manager's scores and hits.
    assert keys(scores) == ["gw"] and set(keys(totals)) == {"gw", "entry"}
    plain = league.gameweek_scores(league.effective_multipliers(star.derived(spark, SF, "picks"), s.auto_subs, s.live, s.live.select("gw").distinct()), s.live)
    assert any("entry" in e or "element" in e for e in exchanges(plain))
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, plain.collect()))


def test_buckets_are_one_number_for_all_tables_and_grow_with_them(spark, monkeypatch):
    described = lambda n: {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {n}").collect()}
    monkeypatch.setattr(star, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(star, "_tables", {})
    buckets = star._buckets(spark, SF)
    assert buckets > star.BUCKETS
    for name in star.BY_KEYS:
        df = star.view(spark, SF, name)
        (table,) = [t for k, t in star._tables.items() if k[2] == name]
        assert described(table)["Num Buckets"] == str(buckets) and len(df.inputFiles()) <= buckets
        assert df.exceptAll(star.derived(spark, SF, name)).isEmpty() and df.count() == star.derived(spark, SF, name).count()


def test_gameweeks_repeated_or_absent(spark):
    picks = spark.createDataFrame([(1, 1, 7, 2, True, False), (1, 1, 8, 1, False, True), (1, 2, 7, 2, True, False)], "entry long, gw int, element long, multiplier int, is_captain boolean, is_vice_captain boolean")
    live = spark.createDataFrame([(1, 7, 9, 0), (1, 8, 5, 90)], "gw int, element long, points int, minutes int")
    subs = spark.createDataFrame([], "entry long, gw int, element_out long, element_in long")
    for final, want in (([1, 1], {(1, 1): 1 * 9 + 2 * 5, (1, 2): 0}), ([], {(1, 1): 2 * 9 + 5, (1, 2): 0})):
        gws = spark.createDataFrame([(g,) for g in final], "gw int")
        for rows in (picks, league.with_live(picks, live)):
            got = league.gameweek_scores(league.effective_multipliers(rows, subs, live, gws), live)
            assert {(r.entry, r.gw): r.score for r in got.collect()} == want


def test_planned_views_are_those_of_their_sql(spark):
    for name in star.PLANNED:
        plain = spark.sql(star.VIEWS[name], **{n: star.view(spark, SF, n) for n in star._needs(star.VIEWS[name])})
        got = star.derived(spark, SF, name)
        assert got.schema.simpleString() == plain.schema.simpleString() and got.count() == plain.count()
        assert got.exceptAll(plain).isEmpty(), name


def test_unsettled_scores_do_not_exchange_picks(spark, no_broadcast):
    plan = exchanges(registry.QUERIES["unsettled_scores"](spark, SF))
    assert {re.sub(r"#\d+L?", "", e) for e in plan} <= {"gw"}


def test_picks_take_points_without_live(spark, no_broadcast, monkeypatch):
    """Lines are joined once for settled picks, and what they carry is all that swings need."""
    monkeypatch.setattr(star, "_tables", {})
    got = registry.QUERIES["player_swings"](spark, SF)
    assert "live" not in {k[2] for k in star._tables}
    assert not [e for e in exchanges(star.derived(spark, SF, "settled_picks")) if "season" in e and "element" not in e]
    assert len([e for e in exchanges(star.derived(spark, SF, "settled_picks")) if "l_orderkey" in e]) == 1
    s = registry.Star(spark, SF)
    plain = league.player_swings(registry._settled(s).drop("points"), s.live, registry._weights(s), s.standings, registry.USER).drop("ever_used").withColumns(registry.r4("swing", "w_swing"))
    rows = lambda df: {r.element: (r.swing, r.w_swing, r.user_points) for r in df.collect()}
    want = rows(plain)
    assert rows(got).keys() == want.keys() and all(v == pytest.approx(want[k], abs=2e-4) for k, v in rows(got).items())


def test_fixtures_are_made_in_as_many_tasks_as_their_size_asks(spark, no_broadcast, monkeypatch):
    """By fixture alone, lines once a use, however few partitions a session shuffles into."""
    monkeypatch.setattr(star, "BUCKET_BYTES", 1 << 9)
    n = star._buckets(spark, SF)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, lines in (("bonus_reconcile", 2), ("player_shots", 1), ("match_shots", 1), ("fixture_bonus", 1)):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan)
        assert len(found) == plan.count("Exchange ") and {k for k, _ in found} == {"l_orderkey", "o_orderkey"} and {p for _, p in found} == {str(n)}, name
        assert len([k for k, _ in found if k == "l_orderkey"]) == lines, name


def test_players_are_dealt_before_their_minutes_and_rates(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(star, "BUCKET_BYTES", 1 << 9)
    for name in ("player_inputs", "estimated_minutes"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"Exchange hashpartitioning\(p_partkey#\d+L?, {star._buckets(spark, SF)}\)", plan), name


def test_published_bonus_that_is_absent_or_repeated(spark):
    scores = spark.createDataFrame([(1, 7, 30), (1, 8, 20), (2, 7, 9), (2, 7, 9), (3, None, 5)], "fixture int, element int, bps int")
    given = spark.createDataFrame([(1, 7, 3), (1, 8, 2), (1, 8, 1), (1, 9, 3), (2, 7, 3), (3, None, 3)], "fixture int, element int, bonus int")
    plain = reconcile.allocate_bonus(scores).join(given.withColumnRenamed("bonus", "given"), ["fixture", "element"], "left").na.fill(0, ["given"])
    want = plain.groupBy("fixture").agg(F.count("*"), F.bool_and(F.col("bonus") == F.col("given")))
    assert sorted(map(tuple, reconcile.reconcile_bonus(scores, given).collect())) == sorted(map(tuple, want.collect())) == [(1, 3, False), (2, 2, True), (3, 1, False)]


def test_rates_are_made_where_a_players_history_lies(spark, no_broadcast):
    """Only sums by position, tier and statistic are shuffled; a row per player and statistic is not."""
    s = registry.Star(spark, SF)
    edges = rates.price_edges(s.history)
    priors = rates.rate_priors(rates.player_seasons(s.history), edges)
    assert not [e for e in exchanges(priors) if "element" in e or "season" in e]
    players = s.history.groupBy(F.col("element").alias("player_id"), "position").agg(F.max("value").alias("price"), F.sum("minutes").alias("minutes"), *[F.sum(c).alias(c) for c in rates.STATS])
    assert not [e for e in exchanges(rates.posterior_rates(players, priors, edges)) if "element" in e or "player_id" in e]


def test_null_statistics_count_for_nothing(spark):
    rows = spark.createDataFrame([(1, 7, 2, 50, 90, 3, None), (1, 7, 2, 60, 30, None, None), (1, 8, 1, 40, 90, 1, 4)], "season int, element int, position int, value int, minutes int, assists int, saves int")
    got = {tuple(r) for r in rates.player_seasons(rows, ("assists", "saves")).collect()}
    assert got == {(1, 7, 2, "assists", 3, 90, 50.0), (1, 8, 1, "saves", 4, 90, 40.0)}
