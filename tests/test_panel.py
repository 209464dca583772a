import math
from datetime import date

import pytest

from tests.world import relations, world
from vantage.functions import config as C
from vantage.plans.players import build_panel
from vantage.sources.relations import RELATIONS, as_of, read_relation, read_relations


def panel_of(spark, tables, cutoff=None):
    raw = {n: as_of(df, RELATIONS[n][1], cutoff) for n, df in relations(spark, tables).items()}
    return {(r.player_id, r.season): r for r in build_panel(spark, raw, first_season=2014).collect()}


@pytest.fixture(scope="module")
def panel(spark):
    return panel_of(spark, world())


def test_keys(panel):
    assert set(panel) == {(p, s) for p in (101, 102, 103) for s in (2014, 2015)}


def test_season_facts(panel):
    r = panel[101, 2014]
    assert (r.end_date, r.apps, r.starts, r.captain_games, r.minutes, r.league_minutes, r.euro_minutes, r.cup_minutes) == (date(2015, 5, 20), 8, 8, 6, 720, 540, 90, 90)
    assert (r.goals, r.assists, r.ga_per90, r.league_minutes_share) == (3, 1, 0.5, 1.0)
    assert panel[102, 2014].league_minutes_share == pytest.approx(480 / 540)
    assert (r.position, r.position_group, panel[103, 2014].position_group, panel[102, 2014].foot, panel[103, 2014].height_cm) == ("Centre-Forward", "Attack", "Midfield", "left", None)


def test_trend(panel):
    r = panel[101, 2014]
    assert (r.prev_minutes, r.prev_observed, r.l3_seasons, r.l3_minutes, r.changed_club) == (720, 1, 2, 1440, 0)


def test_club(panel):
    r = panel[101, 2014]
    assert (r.club_position, r.club_position_pct, r.club_ppg, r.club_gd_per_game, r.club_in_europe, r.club_players_used) == (1, 0.5, 2.0, 0.5, 1, 1)
    assert (r.club_foreign_share, r.club_n_transfers, r.club_fee_disclosed_share) == (0, 2, 0.5)
    assert r.club_fees_in_rel * math.exp(r.market_index) == pytest.approx(3e6)
    assert (panel[102, 2014].club_n_transfers, panel[102, 2014].club_fee_disclosed_share) == (0, None)


def test_market(panel):
    r = panel[101, 2014]
    assert (r.target_value, r.target_date) == (12_000_000, date(2015, 6, 10))
    assert r.market_index == pytest.approx(sum(map(math.log, (12e6, 2e6, 4e6))) / 3)
    assert r.y == pytest.approx(math.log(12e6) - r.market_index)
    for name, value in (("val_last_rel", 10e6), ("val_season_start_rel", 12e6), ("val_peak_rel", 12e6), ("val_12m_rel", 10e6)):
        assert getattr(r, name) == pytest.approx(math.log(value) - r.market_index), name
    assert r.days_since_val_last == 156
    assert (r.bt_last_update_log_change, r.outcome_future_value, r.outcome_log_change) == (pytest.approx(math.log(1.2)), 12_000_000, 0)
    assert panel[101, 2015].outcome_log_change is None


def test_citizenship_flags(panel):
    assert [panel[p, 2014].is_eu_eea for p in (101, 102, 103)] == [1, 0, 1]
    assert [panel[p, 2014].is_domestic for p in (101, 102, 103)] == [1, 0, 1]


def same_features(a, b, keys):
    for k in keys:
        for f in C.feature_columns("ceiling"):
            x, y = getattr(a[k], f), getattr(b[k], f)
            assert x == y or x == pytest.approx(y), (k, f)


def test_rows_after_the_season_change_no_feature(spark, panel):
    t = world()
    t["games"].append((900, "CL", 2014, date(2015, 6, 1), 1, 3, 5, 0, None, None, "international_cup"))
    t["appearances"].append((900, 101, 1, date(2015, 6, 1), "CL", 0, 0, 4, 0, 90))
    t["game_lineups"].append((900, 101, 1, date(2015, 6, 1), "starting_lineup", "Left Winger", 1))
    t["transfers"].append((777, date(2015, 6, 5), "14/15", 50, 1, 50e6))
    t["player_valuations"].append((101, date(2015, 5, 25), 99_000_000, "GB1"))
    changed = panel_of(spark, t)
    main = {k: r for k, r in changed.items() if k[1] == 2014}
    for k in main:
        for f in C.feature_columns("main"):
            assert getattr(main[k], f) == getattr(panel[k], f), (k, f)
    assert changed[101, 2014].target_value == 99_000_000


def test_value_inside_the_season_reaches_history_only(spark, panel):
    t = world()
    t["player_valuations"].append((101, date(2015, 3, 1), 99_000_000, "GB1"))
    changed = panel_of(spark, t)
    assert changed[101, 2014].target_value == panel[101, 2014].target_value
    assert changed[101, 2014].val_last_rel != panel[101, 2014].val_last_rel


def test_time_travel(spark, panel):
    then = panel_of(spark, world(), date(2015, 6, 30))
    assert {s for _, s in then} == {2014}
    same_features(then, panel, then)
    assert panel_of(spark, world(), date(2015, 3, 1)) == {}


@pytest.mark.parametrize(("player", "paid"), [(101, 0), (555, 20e6)])
def test_own_fee_stays_out(spark, panel, player, paid):
    t = world()
    t["transfers"].append((player, date(2014, 8, 10), "14/15", 50, 1, 20e6))
    r = panel_of(spark, t)[101, 2014]
    assert r.club_fees_in_rel - panel[101, 2014].club_fees_in_rel == pytest.approx(paid / math.exp(r.market_index))


def test_csv(spark, tmp_path, panel):
    for name, df in relations(spark, world()).items():
        df.withColumn("extra", df[df.columns[0]]).coalesce(1).write.csv(str(tmp_path / f"{name}.csv"), header=True)
    rows = {(r.player_id, r.season): r for r in build_panel(spark, str(tmp_path), first_season=2014).collect()}
    assert set(rows) == set(panel)
    same_features(rows, panel, panel)
    assert read_relations(spark, str(tmp_path), date(2015, 1, 1))["games"].where("date > '2015-01-01'").isEmpty()
    with pytest.raises(FileNotFoundError):
        read_relation(spark, str(tmp_path / "nowhere"), "games")


def test_feature_contract():
    assert len(C.feature_columns("main")) == 52 and len(C.feature_columns("ceiling")) == 58
    assert not [f for f in C.feature_columns("ceiling") for bad in C.FORBIDDEN if bad in f]
    with pytest.raises(ValueError):
        C.feature_columns("other")
