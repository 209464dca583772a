"""The point-in-time panel of players and seasons from the eight input relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C
from ..operators import activity as A
from ..operators import groups as G
from ..operators import market as M
from ..operators.cleaning import clean_all
from ..sources.relations import read_relations, stored

KEY = ["player_id", "season"]
CLUB = ["club_id", "season", "league"]


def calendar(t: dict[str, DataFrame]) -> DataFrame:
    games = t["games"].where(F.col("competition_id").isin(*C.LEAGUES)).withColumnRenamed("competition_id", "league")
    last = t["games"].agg(F.max("date")).first()[0]  # one date; the data's end counts all competitions
    seasons = A.season_calendar(games, data_end=F.lit(last))
    names = t["competitions"].select(F.col("competition_id").alias("league"), "country_name", F.col("name").alias("league_name"))
    return seasons.join(F.broadcast(names), "league", "left")  # a row a competition


def tagged_appearances(t: dict[str, DataFrame]) -> DataFrame:
    games = t["games"].select("game_id", "season", "competition_type")
    return t["appearances"].join(games, "game_id").select(
        *t["appearances"].columns, "season", F.coalesce(F.col("competition_id").isin(*C.LEAGUES), F.lit(False)).alias("is_league"),
        F.coalesce(F.col("competition_id").isin(*C.EURO_CUPS), F.lit(False)).alias("is_euro"),
        F.coalesce(F.col("competition_type") == C.DOMESTIC_CUP, F.lit(False)).alias("is_cup"),
    )


def main_seasons(app: DataFrame, seasons: DataFrame) -> DataFrame:
    league_games = app.where("is_league").withColumnRenamed("competition_id", "league")
    known = league_games.join(F.broadcast(seasons.select("league", "season")), ["league", "season"], "left_semi")
    return A.main_affiliation(known, KEY, ["league", "club_id"], "minutes").join(F.broadcast(seasons), ["league", "season"])


def season_stats(app: DataFrame, main: DataFrame) -> DataFrame:
    own = main.select(*KEY, F.col("club_id").alias("main_club_id"), "end_date")
    total = lambda name, *when: F.coalesce(F.sum(F.when(F.expr(" and ".join(when)), F.col("minutes"))), F.lit(0)).alias(name)
    return A.bounded(app, own, KEY).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("apps"), *(F.sum(c).alias(c) for c in ("minutes", "goals", "assists", "yellow_cards", "red_cards")),
        total("league_minutes", "is_league"), total("main_club_league_minutes", "is_league", "club_id = main_club_id"), total("euro_minutes", "is_euro"),
        total("cup_minutes", "is_cup"), F.countDistinct("club_id").alias("n_clubs_season"), F.max("date").alias("_max_app_date"),
    )


def lineup_stats(t: dict[str, DataFrame], app: DataFrame, main: DataFrame) -> DataFrame:
    rows = t["game_lineups"].join(t["games"].select("game_id", "season"), "game_id")
    rows = A.bounded(rows, main.select(*KEY, "end_date"), KEY).join(app.select("game_id", "player_id", F.lit(True).alias("has_app")), ["game_id", "player_id"], "left")
    played = F.col("has_app").isNotNull()
    counted = rows.groupBy(*KEY).agg(
        F.count_if(F.col("is_starter") & played).alias("starts"), F.count_if(F.col("is_captain") & played).alias("captain_games"), F.max("date").alias("_max_lineup_date")
    )
    modal = A.modal_category(rows, KEY, "position", C.BROAD_POSITIONS).withColumnRenamed("position", "season_position")
    return counted.join(modal, KEY, "left")


def club_results(t: dict[str, DataFrame], seasons: DataFrame) -> DataFrame:
    games = t["games"].where(F.col("competition_id").isin(*C.LEAGUES)).withColumnRenamed("competition_id", "league")
    side = lambda a, b: {"club_id": f"{a}_club_id", "gf": f"{a}_club_goals", "ga": f"{b}_club_goals", "pos": f"{a}_club_position"}
    long = G.two_sided(games, ["season", "league", "date"], side("home", "away"), side("away", "home"))
    inside = A.bounded(long, F.broadcast(seasons.select("league", "season", "end_date")), ["league", "season"])
    named = {"games": "club_games", "ppg": "club_ppg", "gd_per_game": "club_gd_per_game", "last_rank": "club_position"}
    return G.results(inside, CLUB).withColumnsRenamed(named)


def clubs_in_europe(t: dict[str, DataFrame], club: DataFrame, seasons: DataFrame) -> DataFrame:
    cups = G.members(t["games"].where(F.col("competition_id").isin(*C.EURO_CUPS)), ["home_club_id", "away_club_id"], ["season", "date"])
    own = club.select(*CLUB).join(F.broadcast(seasons.select("league", "season", "end_date")), ["league", "season"])
    return A.bounded(cups, own, ["club_id", "season"]).select(*CLUB).distinct().withColumn("club_in_europe", F.lit(True))


def club_squads(t: dict[str, DataFrame], app: DataFrame, seasons: DataFrame) -> DataFrame:
    rows = A.bounded(app.where("is_league").withColumnRenamed("competition_id", "league"), F.broadcast(seasons.select("league", "season", "end_date", "country_name")), ["league", "season"])
    rows = rows.join(t["players"].select("player_id", "date_of_birth", "citizenship"), "player_id", "left")
    return rows.groupBy(*CLUB).agg(
        F.countDistinct("player_id").alias("club_players_used"),
        G.weighted_mean(K.years_between(F.col("date_of_birth"), F.col("end_date")), F.col("minutes")).alias("club_avg_age"),
        G.share(F.col("citizenship") != F.col("country_name"), F.col("minutes")).alias("club_foreign_share"),
    )


def club_flows(t: dict[str, DataFrame], club: DataFrame, seasons: DataFrame) -> DataFrame:
    moves = G.in_and_out(t["transfers"], ["fee", F.col("transfer_date").alias("date"), "transfer_season"], "to_club_id", "from_club_id")
    own = club.select(*CLUB).join(F.broadcast(seasons.select("league", "season", "end_date")), ["league", "season"])
    own = own.withColumn("transfer_season", K.transfer_season_label(F.col("season")))
    named = {"fees_in": "club_fees_in", "fees_out": "club_fees_out", "n_moves": "club_n_transfers", "disclosed_share": "club_fee_disclosed_share", "last_move": "_max_transfer_date"}
    return G.flows(A.bounded(moves, own, ["club_id", "transfer_season"]), CLUB).withColumnsRenamed(named)


def own_fees(t: dict[str, DataFrame], main: DataFrame) -> DataFrame:
    own = main.select(*KEY, "club_id", "end_date", K.transfer_season_label(F.col("season")).alias("transfer_season"))
    rows = A.bounded(t["transfers"], own, ["player_id", "transfer_season"], "transfer_date")
    part = lambda side: F.coalesce(F.sum(F.when(F.col(f"{side}_club_id") == F.col("club_id"), F.col("fee"))), F.lit(0.0))
    return rows.groupBy(*KEY).agg(part("to").alias("own_in"), part("from").alias("own_out"))


def player_seasons(t: dict[str, DataFrame], seasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity-season facts, and the tagged appearances."""
    app = stored(tagged_appearances(t))
    main = main_seasons(app, seasons)
    rows = main.join(season_stats(app, main), KEY).join(lineup_stats(t, app, main), KEY, "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("starts", "captain_games")}
    return rows.withColumns(filled | {"ga": F.col("goals") + F.col("assists")}), app


def build_panel(
    spark: SparkSession, source: str | dict[str, DataFrame], cutoff=None, first_season: int = C.FIRST_SEASON, min_minutes: int = C.MIN_MINUTES,
) -> DataFrame:
    """One row a player and season, from a folder of CSVs or from relations; with ``cutoff`` as if read on that day.

    What several joins read (calendar, appearances, seasons, values, index, targets, clubs) is stored once in the shared folder.

    Group facts are joined on club, season and league, so that a club in two leagues doesn't multiply rows.
    """
    raw = read_relations(spark, source, cutoff) if isinstance(source, str) else source
    t = clean_all(raw)
    seasons = stored(calendar(t))
    facts, app = player_seasons(t, seasons)
    facts = stored(facts)
    values = stored(t["player_valuations"])
    population = facts.where(F.col("minutes") >= C.MIN_MINUTES).select("player_id", (F.col("season") + 1).alias("season"), "league")
    population = population.withColumn("asof_date", F.make_date(F.col("season").cast("int"), F.lit(7), F.lit(1)))
    index = stored(M.market_index(population, values, "player_id", "league"))
    target = stored(M.targets(facts, values, "player_id"))
    cutoffs = target.join(facts.select(*KEY, "start_date", "end_date"), KEY).withColumn("cutoff", F.least("end_date", F.date_sub("target_date", 1)))
    history = M.value_history(cutoffs, values, "player_id")
    later = M.outcomes(target, values, "player_id")
    club = stored(club_results(t, seasons))

    carried = ["club_id", "league", "minutes", "apps", "ga"]
    rows = (
        facts.where(F.col("complete") & (F.col("season") >= first_season) & (F.col("minutes") >= min_minutes))
        .join(target, KEY).join(t["players"].where("date_of_birth is not null"), "player_id")
        .join(t["clubs"].select("club_id", F.col("name").alias("club_name")), "club_id", "left")
        .join(A.previous_season(facts, "player_id", "season", carried), KEY, "left")
        .join(A.trailing(facts, "player_id", "season", {"minutes": "l3_minutes", "goals": "l3_goals", "assists": "l3_assists"}, "l3_seasons"), KEY, "left")
        .join(club, CLUB, "left").join(clubs_in_europe(t, club, seasons), CLUB, "left").join(club_squads(t, app, seasons), CLUB, "left")
        .join(club_flows(t, club, seasons), CLUB, "left").join(own_fees(t, main=facts), KEY, "left")
        .join(index.where(F.col("league") == M.ALL).select("season", F.col("asof_date").alias("_index_asof_date"), F.col("idx").alias("market_index")), "season")
        .join(index.where(F.col("league") != M.ALL).select("season", "league", F.col("idx").alias("league_index")), ["season", "league"], "left")
        .join(M.index_at(index, "index_at_target", 1), "season", "left").join(M.index_at(index, "index_at_future", 2), "season", "left")
        .join(history, KEY, "left").join(later, KEY, "left")
    )
    return panel_columns(rows)


def panel_columns(rows: DataFrame) -> DataFrame:
    c = F.col
    per90 = lambda x, minutes="minutes": K.ratio(x * 90.0, c(minutes))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    relative = lambda x: F.ln(c(x)) - c("market_index")
    fees_in, fees_out = G.without_own(c("club_fees_in"), c("own_in")), G.without_own(c("club_fees_out"), c("own_out"))
    level, seen = F.exp("market_index"), c("prev_seen").isNotNull()
    uk = c("citizenship").isin(*C.UK) & (c("end_date") < F.lit(C.BREXIT))
    change = F.ln(c("future_value") / c("target_value"))
    columns = {
        "season_label": K.season_label(c("season")),
        "age": K.years_between(c("date_of_birth"), c("end_date")),
        "is_domestic": flag(c("citizenship") == c("country_name")), "is_eu_eea": flag(F.coalesce(c("citizenship").isin(*C.EU_EEA), F.lit(False)) | F.coalesce(uk, F.lit(False))),
        "position": F.coalesce("season_position", "profile_position"),
        "position_group": F.coalesce(K.position_group(c("season_position")), c("profile_position_group")),
        "goals_per90": per90(c("goals")), "assists_per90": per90(c("assists")), "ga_per90": per90(c("ga")), "cards_per90": per90(c("yellow_cards") + 2 * c("red_cards")),
        "league_minutes_share": K.capped_ratio(c("main_club_league_minutes"), c("club_games") * 90.0), "start_share": K.ratio(c("starts"), c("apps")),
        "changed_club": F.when(seen, (c("prev_club_id") != c("club_id")).cast("int")), "changed_league": F.when(seen, (c("prev_league") != c("league")).cast("int")),
        "prev_observed": seen.cast("int"), "prev_ga_per90": per90(c("prev_ga"), "prev_minutes"), "minutes_delta": c("minutes") - c("prev_minutes"),
        "ga_per90_delta": per90(c("ga")) - per90(c("prev_ga"), "prev_minutes"),
        "club_position_pct": K.ratio(c("club_position"), c("n_clubs")), "club_in_europe": flag(c("club_in_europe")),
        "club_net_spend_rel": (fees_in - fees_out) / level, "club_fees_in_rel": fees_in / level, "club_fees_out_rel": fees_out / level,
        "club_n_transfers": F.coalesce("club_n_transfers", F.lit(0)),
        "league_index_rel": c("league_index") - c("market_index"), "y": relative("target_value"),
        "val_last_rel": relative("val_last"), "val_season_start_rel": relative("val_season_start"), "val_peak_rel": relative("val_peak"), "val_12m_rel": relative("val_12m"),
        "val_trend_12m": F.ln("val_last") - F.ln("val_12m"), "days_since_val_last": F.datediff("end_date", "val_hist_date"),
        "bt_last_update_log_change": c("last_update_log_change"), "outcome_future_value": c("future_value"), "outcome_future_date": c("future_date"),
        "outcome_log_change": change, "outcome_rel_change": change - (c("index_at_future") - c("index_at_target")),
        "_val_hist_date": c("val_hist_date"), "_val_cutoff": c("val_cutoff"),
    }
    identity = ["player_id", "season", "season_label", "name", "club_id", "club_name", "league", "league_name", "contract_expiration_date", "start_date", "end_date", "target_date", "target_value", "citizenship"]
    features = [f for f in (*C.NUMERIC, *C.CATEGORICAL)]
    later = ["bt_last_update_log_change", "index_at_target", "index_at_future", "outcome_future_value", "outcome_future_date", "outcome_log_change", "outcome_rel_change"]
    audit = ["_max_app_date", "_max_lineup_date", "_max_transfer_date", "_val_hist_date", "_val_cutoff", "_index_asof_date"]
    get = lambda n: columns.get(n, c(n))
    numeric = {*C.NUMERIC, *C.VALUE_HISTORY, "y", "market_index"}
    names = [*identity, *features, "market_index", "y", *C.VALUE_HISTORY, *later, *audit]
    return rows.select(*((get(n).cast("double") if n in numeric else get(n)).alias(n) for n in names))
