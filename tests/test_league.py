"""A league of four managers with numbers computed by hand."""

import pytest

from touchline.operators import league

POINTS = {1: 3, 2: 6, 3: 4, 4: 2, 5: 8, 6: 0, 7: 5, 8: 1}
MINUTES = {1: 90, 2: 90, 3: 90, 4: 90, 5: 90, 6: 0, 7: 90, 8: 90}
#: element, multiplier; captain and vice of each entry.
SQUADS = {
    101: ([(1, 2), (4, 1), (5, 1), (8, 1), (6, 0)], 1, 4), 102: ([(1, 1), (2, 2), (3, 1), (7, 1), (6, 0)], 2, 3),
    103: ([(1, 2), (2, 1), (3, 1), (7, 1), (4, 0)], 1, 2), 104: ([(2, 2), (3, 1), (5, 1), (7, 1), (8, 0)], 2, 5),
}
TOTALS = {101: 17, 102: 24, 103: 21, 104: 29}
USER = 101


class Toy:
    def __init__(self, spark, points=POINTS, minutes=MINUTES, subs=()):
        self.standings = spark.createDataFrame([(e, f"team{e}", f"mgr{e}", r, TOTALS[e]) for r, e in enumerate(sorted(TOTALS, key=lambda e: -TOTALS[e]), 1)], "entry int, entry_name string, player_name string, rank int, total int")
        rows = [(e, 1, el, i + 1, m, el == c, el == v) for e, (squad, c, v) in SQUADS.items() for i, (el, m) in enumerate(squad)]
        self.picks = spark.createDataFrame(rows, "entry int, gw int, element int, slot int, multiplier int, is_captain boolean, is_vice_captain boolean")
        self.live = spark.createDataFrame([(1, e, points[e], minutes[e]) for e in points], "gw int, element int, points int, minutes int")
        self.subs = spark.createDataFrame(list(subs), "entry int, gw int, element_out int, element_in int")
        self.manager_gw = spark.createDataFrame([(e, 1, t, 1000, 0, 0, 0) for e, t in TOTALS.items()], "entry int, gw int, points int, value int, bank int, hits int, points_on_bench int")
        self.final = spark.createDataFrame([(1,)], "gw int")
        self.none = spark.createDataFrame([], "gw int")

    def settled(self, final=True):
        return league.effective_multipliers(self.picks, self.subs, self.live, self.final if final else self.none)


@pytest.fixture(scope="module")
def toy(spark):
    return Toy(spark)


def rows(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("scheme", league.SCHEMES)
def test_weights_add_up_to_one(toy, scheme):
    w = rows(league.threat_weights(toy.standings, USER, scheme), "entry")
    assert set(w) == {102, 103, 104} and sum(r.weight for r in w.values()) == pytest.approx(1.0)


def test_unknown_scheme(toy):
    with pytest.raises(ValueError):
        league.threat_weights(toy.standings, USER, "other")


def test_gap_weights_are_uniform_when_nobody_is_ahead(spark, toy):
    w = rows(league.threat_weights(toy.standings, 104, "gap"), "entry")
    assert all(r.weight == pytest.approx(1 / 3) for r in w.values())


def test_ownership(toy):
    own = rows(league.ownership_table(toy.standings, toy.picks, league.threat_weights(toy.standings, USER), 1, USER), "element")
    assert (own[1].owned_pct, own[1].captain_pct, own[1].eo_pct) == (75.0, 50.0, 125.0)
    assert own[1].user_owns and own[1].user_mult == 2 and not own[2].user_owns


def test_swings_add_up_to_the_margin(toy):
    sw = rows(league.player_swings(toy.settled(), toy.live, league.threat_weights(toy.standings, USER), toy.standings, USER), "element")
    assert sw[1].swing == pytest.approx(2.25) and sw[2].swing == pytest.approx(-7.5)
    assert sum(r.swing for r in sw.values()) == pytest.approx(17 - (17 + 24 + 21 + 29) / 4) == pytest.approx(-5.75)


def test_scores_and_totals(toy, spark):
    scores = league.gameweek_scores(toy.settled(), toy.live)
    assert {r.entry: r.score for r in scores.collect()} == TOTALS
    assert all(r.delta == 0 for r in league.verify_totals(toy.standings, scores, toy.manager_gw).collect())


def test_vice_takes_over_only_when_final(spark):
    blank = Toy(spark, POINTS | {1: 0}, MINUTES | {1: 0})
    settled = {(r.entry, r.element): r.multiplier for r in blank.settled().collect()}
    assert (settled[101, 1], settled[101, 4]) == (1, 2)
    assert {r.entry: r.score for r in league.gameweek_scores(blank.settled(), blank.live).collect()}[101] == 13
    running = {(r.entry, r.element): r.multiplier for r in blank.settled(final=False).collect()}
    assert (running[101, 1], running[101, 4]) == (2, 1)


def test_automatic_substitutes(spark):
    subbed = Toy(spark, POINTS | {5: 0, 6: 7}, MINUTES | {5: 0, 6: 90}, [(101, 1, 5, 6)])
    assert {r.entry: r.score for r in league.gameweek_scores(subbed.settled(), subbed.live).collect()}[101] == 16


def test_gaps(toy):
    g = rows(league.gap_targets(toy.standings, USER, 36), "label")
    assert (g["1st"].total, g["1st"].gap) == (29, 12) and g["1st"].per_gw == pytest.approx(12 / 36)
    assert g["median"].gap == 5 and g["one place up"].gap == 4
    assert g["top-5"].total == 17 and g["top-10"].total == 17


def test_overlap(toy):
    o = rows(league.squad_overlap(toy.standings, toy.picks, USER, 1), "entry")
    assert set(o) == {102, 103, 104}
    assert (o[102].shared_squad, o[102].shared_xi, o[102].live_edge, o[102].shared_pct, o[102].dead_weight_pct) == (2, 1, 3, 40.0, 20.0)
    assert o[103].dead_weight_pct == 40.0 and o[104].dead_weight_pct == 20.0


def test_catchup_and_noise(toy):
    c = league.catchup_plan(toy.standings, USER, 1, 36).first()
    assert c.required_ppg == pytest.approx(29 + 12 / 36) and c.league_ppg == pytest.approx(22.75)
    n = league.win_context(toy.standings, toy.manager_gw, USER).first()
    assert n.sd_gw_score == pytest.approx(4.380353866983808) and n.first_in_sd == pytest.approx(12 / (n.sd_gw_diff * 6))


def test_profiles(toy, spark):
    moves = spark.createDataFrame([(102, 1, 2, 5)], "entry int, gw int, element_in int, element_out int")
    chips = spark.createDataFrame([(102, "wildcard", 1), (102, "wildcard", 1)], "entry int, name string, gw int")
    p = rows(league.profiles(toy.standings, toy.picks, toy.manager_gw, moves, chips, league.threat_weights(toy.standings, USER), USER, 1), "entry")
    assert p[101].template_score == pytest.approx(100 * (2 + 1 + 1 + 1 + 1) / 3 / 5)
    assert p[102].n_transfers == 1 and "wildcard" not in p[102].chips_left and p[104].gap_to_user == 12
    assert sum(r.managers for r in league.style_summary(league.template_scores(toy.standings, toy.picks, 1)).collect()) == 4


def test_lists(toy, spark):
    players = spark.createDataFrame([(e, f"P{e}", "CLB", "MID") for e in POINTS], "element int, name string, team string, position string")
    lines = [r.line for r in league.squad_lines(toy.standings, toy.picks, players, toy.live, 1).where("entry = 101").orderBy("place").collect()]
    assert len(lines) == 5 and lines[-1].startswith("BENCH ") and any("(C)" in x for x in lines)
    log = league.transfer_log(spark.createDataFrame([(1, 2, 5, 99)], "entry int, gw int, element_in int, element_out int"), players).first()
    assert log.line == "GW2: #99 -> P5"
    targets = league.transfer_targets(toy.standings, toy.picks, USER, 1, 2)
    assert {r.element: r.group_owners for r in targets.collect()} == {2: 2, 3: 2, 7: 2}
    assert rows(league.captaincy_table(toy.standings, toy.picks, toy.live, 1), "element")[2].captains == 2
