import pytest
from pyspark.sql import functions as F

from touchline.operators import monitor, state


@pytest.mark.parametrize("bought,now,out", [(75, 80, 77), (100, 90, 90), (100, 101, 100), (100, 103, 101), (100, 110, 105)])
def test_selling_price(spark, bought, now, out):
    assert spark.range(1).select(state.selling_price(F.lit(bought), F.lit(now)).alias("p")).first().p == out


def test_free_transfers(spark):
    cases = {1: ([0], {}, 1), 2: ([0, 0], {}, 2), 3: ([0, 1], {}, 1), 4: ([0, 3], {}, 1), 5: ([0] * 9, {}, 5), 6: ([0, 0, 15], {3: "wildcard"}, 2), 7: ([0, 0, 11], {3: "freehit"}, 2)}
    rows = [(k, g, m, chips.get(g)) for k, (made, chips, _) in cases.items() for g, m in enumerate(made, 1)]
    got = {r.entry: r.free for r in state.free_transfers(spark.createDataFrame(rows, "entry int, gw int, made int, chip string")).collect()}
    assert got == {k: v[2] for k, v in cases.items()}


def test_purchase_prices_take_the_latest(spark):
    held = spark.createDataFrame([(1, 7), (1, 8)], "entry int, element int")
    moves = spark.createDataFrame([(1, 7, "2026-01-01", 50), (1, 7, "2026-02-01", 55)], "entry int, element_in int, time string, element_in_cost int")
    prices = spark.createDataFrame([(7, 60, 3), (8, 45, -2)], "element int, now_cost int, cost_change_start int")
    assert {r.element: r.bought for r in state.purchase_prices(held, moves, prices).collect()} == {7: 55, 8: 47}


def test_objectives(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 4.0, 3.0), (3, 3.0, 2.0)], "player_id int, ep double, sd double")
    eo = spark.createDataFrame([(1, 1.0), (2, 0.0)], "player_id int, eo double")
    got = {r.player_id: r.objective_score for r in state.rank_utility(df, eo, 2.0).collect()}
    assert got == {1: 5.0, 2: 10.0, 3: 7.0}
    assert [r.objective_score for r in state.plain_objective(df).orderBy("player_id").collect()] == [5.0, 4.0, 3.0]
    with pytest.raises(ValueError):
        state.rank_utility(df, eo, -0.1)
    with pytest.raises(ValueError):
        state.rank_utility(df.drop("sd"), eo, 1.0)
    assert state.recommended_lambda(88, 36) == pytest.approx(0.15 + 0.08 * 88 / 36)
    assert state.recommended_lambda(88, 3) == pytest.approx(1.15) and state.recommended_lambda(0, 36, base=0.2) == 0.2


def test_squad_faults(spark):
    squad = [(1, i, p, i) for i, p in enumerate([1] * 2 + [2] * 5 + [3] * 5 + [4] * 3)]
    bad = [(2, i, 3, 0) for i in range(4)]
    held = spark.createDataFrame(squad + bad, "entry int, element int, position int, team int")
    managers = spark.createDataFrame([(1, 0, 1), (2, -1, 9)], "entry int, bank int, free int")
    out = {r.entry: r.faults for r in state.squad_faults(held, managers).collect()}
    assert out[1] == [] and {"size", "club", "bank", "free transfers", "position 1"} <= set(out[2])


def test_candidate_pool_drops_the_beaten_and_keeps_the_owned(spark):
    rows = [(1, 1, 3, 50, 5.0), (2, 1, 3, 55, 4.0), (3, 1, 3, 50, 5.0), (4, 1, 4, 90, 1.0)]
    df = spark.createDataFrame(rows, "player_id int, gw int, position int, price int, ep double")
    assert {r.player_id for r in state.candidate_pool(df, 5).collect()} == {1, 3, 4}
    owned = spark.createDataFrame([(2,)], "player_id int")
    assert {r.player_id for r in state.candidate_pool(df, 5, owned).collect()} == {1, 2, 3, 4}


ELEMENT = "id int, web_name string, element_type int, minutes int, now_cost int, status string, news string, team string, chance_of_playing_next_round int"


def element(i, minutes=180, price=60, status="a", pos=4, chance=None):
    return (i, f"P{i}", pos, minutes, price, status, "", "CLB", chance)


def kinds(df):
    return {(r.player_id, r.kind): r for r in df.collect()}


def test_risks(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), ELEMENT)
    risks = kinds(monitor.scan_risks(make(element(1, 0, 79), element(2, status="u"), element(3, 60, 50), element(4, status="d", chance=75)), 2))
    assert risks[1, "zero-minutes"].severity == "critical" and risks[1, "zero-minutes"].needs_check
    assert risks[2, "flagged"].severity == "critical" and not risks[2, "flagged"].needs_check
    assert risks[3, "low-minutes"].severity == "medium" and risks[4, "flagged"].severity == "high"
    assert {k for _, k in kinds(monitor.scan_risks(make(element(1, 0)), 1))} == {"low-minutes"}
    assert monitor.scan_risks(make(element(1, 60), element(2, status="u")), 2).first().severity == "critical"
    squad = spark.createDataFrame([(1,), (2,), (3,)], "player_id int")
    own = kinds(monitor.squad_risks(make(element(1, 180, 50, pos=1), element(2, 0, 40, pos=1), element(3, 0, 79)), squad, 2))
    assert {p for p, _ in own} == {3}
    questions = monitor.open_questions(monitor.scan_risks(make(element(1, 0, 79), element(2, status="u")), 2))
    assert questions.count() == 1


def test_dropped_and_sold(spark):
    trend = monitor.minutes_trend(spark.createDataFrame([(1, 1, 90), (1, 2, 0)], "player_id int, gw int, minutes int"))
    prices = spark.createDataFrame([(1, -900, -80.0)], "player_id int, hourly_rate int, proj_pct_today double")
    found = kinds(monitor.scan_risks(spark.createDataFrame([element(1)], ELEMENT), 2, trend, prices))
    assert {k for _, k in found} == {"dropped", "market-selling"}


def test_prices(spark):
    schema = (
        "id int, web_name string, team int, element_type int, now_cost int, cost_change_start int, cost_change_event int, transfers_in_event int, transfers_out_event int, selected_by_percent string, "
        "price_change_hourly_rate int, price_change_projections array<struct<offset int, projected_percent string, likelihood int>>, price_change_locked_until string, price_change_calibrating boolean, status string"
    )
    rows = [(1, "A", 1, 4, 80, 0, 0, 10, 4, "11.8", 5, [(1, "20.5", 1), (0, "90.0", 3)], None, False, "a"), (2, "B", 1, 4, 80, None, 0, None, 4, "x", 5, [(0, "bad", 1)], None, None, "a")]
    snap = monitor.price_rows(spark.createDataFrame(rows, schema), F.lit("2026-01-01").cast("timestamp"))
    assert tuple(snap.columns) == monitor.SNAPSHOT
    got = {r.player_id: r for r in snap.collect()}
    assert (got[1].net_transfers_event, got[1].proj_pct_today, got[1].proj_pct_tomorrow, got[1].selected_by_percent) == (6, 90.0, 20.5, 11.8)
    assert (got[2].net_transfers_event, got[2].proj_pct_today, got[2].selected_by_percent, got[2].calibrating) == (-4, None, 0.0, False)
    assert [(r.player_id, r.direction) for r in monitor.movers(snap).collect()] == [(1, "rise")]
    assert monitor.movers(snap.withColumn("locked_until", F.lit("soon"))).count() == 0
