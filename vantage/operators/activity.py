"""What an entity did in a season: calendar, main affiliation, totals bounded by the season's end, modal category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C


def season_calendar(games: DataFrame, league: str = "league", season: str = "season", ts: str = "date", club: str = "home_club_id", data_end: Column | None = None) -> DataFrame:
    """A row a league and season: start, end, games, clubs, and whether it is complete.

    Complete: a later season has begun, or it has 85 % of the games of the league's season before, or it has had no game
    for over 30 days and its last one was in March to July. The data's end is the latest date in ``games`` unless given.
    """
    by = Window.partitionBy(league).orderBy(season)
    rows = games.groupBy(league, season).agg(
        F.min(ts).alias("start_date"), F.max(ts).alias("end_date"), F.count(F.lit(1)).alias("n_games"), F.countDistinct(club).alias("n_clubs")
    )
    if data_end is None:
        rows = rows.crossJoin(F.broadcast(games.agg(F.max(ts).alias("_end"))))  # one row
        data_end = F.col("_end")
    idle = (F.col("end_date") < F.date_sub(data_end, C.IDLE_DAYS)) & F.month("end_date").between(*C.END_MONTHS)
    enough = F.coalesce(F.col("n_games") >= C.COMPLETE_SHARE * F.lag("n_games").over(by), F.lit(False))
    return rows.withColumn("complete", F.lead(season).over(by).isNotNull() | enough | idle).drop("_end")


def main_affiliation(activity: DataFrame, keys: list[str], affiliation: list[str], weight: str, n: Column | None = None) -> DataFrame:
    """Of each key the affiliation with the most weight, then most rows, then the smallest names. ``n``: rows that a row stands for, else one."""
    sums = activity.groupBy(*keys, *affiliation).agg(F.sum(weight).alias("_m"), (F.count(F.lit(1)) if n is None else F.sum(n)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_m"), F.desc("_n"), *(F.col(a).asc_nulls_last() for a in reversed(affiliation)))
    return sums.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, *affiliation)


def bounded(activity: DataFrame, seasons: DataFrame, keys: list[str], ts: str = "date", end: str = "end_date") -> DataFrame:
    """Activity joined to its key's season, dated up to that season's end."""
    return activity.join(seasons, keys).where(F.col(ts) <= F.col(end))


def modal_category(rows: DataFrame, keys: list[str], category: str, broad: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent category; of equally frequent ones a specific one before a broad one, then by name. Nulls don't count."""
    counts = rows.where(F.col(category).isNotNull()).groupBy(*keys, category).count()
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), F.col(category).isin(*broad) if broad else F.lit(False), category)
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, category)


def trailing(rows: DataFrame, entity: str, season: str, sums: dict[str, str], count_as: str, n: int = 3) -> DataFrame:
    """Sums over the season and the ``n`` - 1 seasons before it by number, gaps left out."""
    by = Window.partitionBy(entity).orderBy(season).rangeBetween(-(n - 1), 0)
    return rows.select(entity, season, F.count(F.lit(1)).over(by).alias(count_as), *(F.sum(c).over(by).alias(name) for c, name in sums.items()))


def previous_season(rows: DataFrame, entity: str, season: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Columns of exactly the season before; after a gap there is none."""
    return rows.select(entity, (F.col(season) + 1).alias(season), F.lit(True).alias(f"{prefix}seen"), *(F.col(c).alias(f"{prefix}{c}") for c in columns))
