"""Cleaning of the input relations, each rule a function of its own, and the deterministic removal of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``, which all further columns complete so that ties don't matter."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))).where("_n = 1").drop("_n")


def clamp(x: Column, low: int = 0, high: int | None = None) -> Column:
    """Null as 0, then no less than low and no more than high."""
    x = F.greatest(F.coalesce(x, F.lit(0)), F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def clean_players(raw: DataFrame) -> DataFrame:
    position = K.normalize_position(F.coalesce("sub_position", "position"))
    return raw.select(
        "player_id", "name", K.birth_date(F.col("date_of_birth")).alias("date_of_birth"), K.normalize_foot(F.col("foot")).alias("foot"),
        K.in_range(F.col("height_in_cm"), *C.HEIGHT_CM).alias("height_cm"), K.non_blank(F.col("country_of_citizenship")).alias("citizenship"),
        position.alias("profile_position"), K.position_group(position).alias("profile_position_group"), F.col("contract_expiration_date").cast("date").alias("contract_expiration_date"),
    )


def clean_appearances(raw: DataFrame) -> DataFrame:
    """One row a game and player, that with the most raw minutes; counts at least 0, minutes physically possible."""
    one = keep_first(raw, ["game_id", "player_id"], F.desc("minutes_played"))
    counts = [clamp(F.col(c)).alias(c) for c in ("yellow_cards", "red_cards", "goals", "assists")]
    return one.select("game_id", "player_id", F.col("player_club_id").alias("club_id"), "date", "competition_id", *counts, clamp(F.col("minutes_played"), 0, C.MAX_MINUTES_PER_GAME).alias("minutes"))


def clean_lineups(raw: DataFrame) -> DataFrame:
    """One row a game and player, a starter's first."""
    starter = F.col("type") == "starting_lineup"
    position = K.normalize_position(F.col("position"))
    one = keep_first(raw, ["game_id", "player_id"], starter.desc_nulls_last())
    return one.select(
        "game_id", "player_id", "club_id", "date", starter.alias("is_starter"), (F.coalesce("team_captain", F.lit(0)) == 1).alias("is_captain"),
        position.alias("position"), K.position_group(position).alias("position_group"),
    )


def clean_series(raw: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """An irregular series: positive values, one a key and date, the largest."""
    return keep_first(raw.where(F.col(value) > 0), [entity, ts], F.desc(value))


def clean_valuations(raw: DataFrame) -> DataFrame:
    one = clean_series(raw, "player_id", "date", "market_value_in_eur")
    return one.select("player_id", "date", F.col("market_value_in_eur").alias("value"), F.col("player_club_domestic_competition_id").alias("league"))


def undisclosed(fee: Column) -> Column:
    """A negative fee is unknown; 0 stays 0."""
    return F.when(fee >= 0, fee)


def clean_transfers(raw: DataFrame) -> DataFrame:
    moved = raw.where(~F.col("from_club_id").eqNullSafe(F.col("to_club_id")))
    return moved.select("player_id", "transfer_date", "transfer_season", "from_club_id", "to_club_id", undisclosed(F.col("transfer_fee")).alias("fee"))


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    rules = {
        "players": clean_players, "appearances": clean_appearances, "game_lineups": clean_lineups, "player_valuations": clean_valuations,
        "transfers": clean_transfers,
    }
    return {name: rules.get(name, lambda df: df)(df) for name, df in raw.items()}
