"""A small world of two leagues, four players and three seasons, whose panel can be worked out by hand."""

from __future__ import annotations

from datetime import date, datetime

from vantage.sources.relations import RELATIONS

SEASONS = (2013, 2014, 2015)
GAME_DAYS = ((8, 15, 0), (9, 15, 0), (10, 15, 0), (2, 15, 1), (4, 15, 1), (5, 20, 1))
CLUBS = {"GB1": (1, 2), "ES1": (3, 4)}


def world() -> dict[str, list[tuple]]:
    born = lambda y, m, d: datetime(y, m, d)
    t: dict[str, list[tuple]] = {name: [] for name in RELATIONS}
    t["players"] = [
        (101, "Ann Striker", born(1995, 6, 1), "Attack", "Centre-Forward", "right", 180.0, "England", born(2017, 6, 30)),
        (102, "Bo Back", born(2000, 1, 1), "Defender", "Centre-Back", "LEFT ", 190.0, "Brazil", None),
        (103, "Cy Middle", born(1990, 3, 3), "Midfield", None, None, 100.0, "Spain", None),
        (104, "Di Keeper", born(1998, 1, 1), "Goalkeeper", "Goalkeeper", "both", 195.0, "Spain", None),
    ]
    t["clubs"] = [(c, f"Club {c}", league) for league, cs in CLUBS.items() for c in cs]
    t["competitions"] = [("GB1", "premier-league", "domestic_league", "England"), ("ES1", "laliga", "domestic_league", "Spain"), ("CL", "champions", "international_cup", None), ("FAC", "cup", "domestic_cup", "England")]
    game = 0
    for s in SEASONS:
        def play(comp, day, home, away, hg, ag, kind, hp=None, ap=None, season=s):
            nonlocal game
            game += 1
            t["games"].append((game, comp, season, day, home, away, hg, ag, hp, ap, kind))
            return game

        def appear(player, club, comp, day, g, minutes, goals=0, assists=0, captain=0, label=None):
            t["appearances"].append((g, player, club, day, comp, 0, 0, goals, assists, minutes))
            t["game_lineups"].append((g, player, club, day, "starting_lineup", label, captain))

        for league, (a, b) in CLUBS.items():
            for i, (m, d, y) in enumerate(GAME_DAYS):
                day, (home, away) = date(s + y, m, d), (a, b) if i % 2 == 0 else (b, a)
                even = i % 2 == 0
                g = play(league, day, home, away, 2 if even else 0, 1 if even else 0, "domestic_league", 1 if home == a else 2, 1 if away == a else 2)
                if league == "GB1":
                    appear(101, 1, league, day, g, 90, goals=1 if i in (0, 2, 4) else 0, assists=1 if i == 1 else 0, captain=1, label="Centre-Forward")
                    appear(102, 2, league, day, g, 80, label="Centre-Back")
                else:
                    appear(103, 3, league, day, g, 90, label="midfield")
                    if i < 2:
                        appear(104, 4, league, day, g, 90, label="Goalkeeper")
        day = date(s, 10, 1)
        appear(101, 1, "CL", day, play("CL", day, 1, 3, 1, 1, "international_cup"), 90, label="Centre-Forward")
        day = date(s + 1, 1, 10)
        appear(101, 1, "FAC", day, play("FAC", day, 1, 2, 1, 0, "domestic_cup"), 90, label="Centre-Forward")
        for player, league, first, second in ((101, "GB1", 10e6, 12e6), (102, "GB1", 1e6, 2e6), (103, "ES1", 5e6, 4e6), (104, "ES1", 5e5, 5e5)):
            t["player_valuations"] += [(player, date(s, 12, 15), int(first), league), (player, date(s + 1, 6, 10), int(second), league)]
        label = f"{s % 100:02d}/{(s + 1) % 100:02d}"
        t["transfers"] += [(900 + s, date(s, 7, 15), label, 50, 1, 3e6), (950 + s, date(s, 8, 1), label, 1, 60, None)]
    return t


def relations(spark, tables: dict[str, list[tuple]]) -> dict:
    return {name: spark.createDataFrame(rows, RELATIONS[name][0]) for name, rows in tables.items()}
