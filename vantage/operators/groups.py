"""What the groups (clubs) of a season are like: results, membership, make-up, flows of fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sided(games: DataFrame, keep: list[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """Each game as two rows, one a side, from one scan. ``home`` and ``away``: new name -> column of that side."""
    sides = F.array(*(F.struct(*(F.col(c).alias(n) for n, c in side.items())) for side in (home, away)))
    return games.select(*keep, F.inline(sides))


def results(long: DataFrame, keys: list[str], scored: str = "gf", conceded: str = "ga", rank: str | None = "pos", ts: str = "date") -> DataFrame:
    """Games, points a game (3 for a win, 1 for a draw), goal difference a game, and the last known rank."""
    points = F.when(F.col(scored) > F.col(conceded), 3).when(F.col(scored) == F.col(conceded), 1).otherwise(0)
    measures = [F.count(F.lit(1)).alias("games"), F.avg(points).alias("ppg"), F.avg(F.col(scored) - F.col(conceded)).alias("gd_per_game")]
    if rank:
        known = F.when(F.col(rank).isNotNull(), F.struct(ts, rank))
        measures.append(F.max(known)[rank].alias("last_rank"))
    return long.groupBy(*keys).agg(*measures)


def members(events: DataFrame, candidates: list[str], keep: list[str], name: str = "club_id") -> DataFrame:
    """Distinct (keep, member) of events that name members in several columns: exploded, so that joins stay on equal keys."""
    return events.select(*keep, F.explode(F.array(*candidates)).alias(name)).where(F.col(name).isNotNull()).distinct()


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of weight x value over the weight of rows that have a value; null without such weight."""
    return F.sum(weight * value) / F.nullif(F.sum(F.when(value.isNotNull(), weight)).cast("double"), F.lit(0.0))


def share(condition: Column, weight: Column) -> Column:
    """Weight of the rows where the condition holds, over all weight."""
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))


def in_and_out(moves: DataFrame, keep: list[str], into: str, out_of: str, name: str = "club_id") -> DataFrame:
    """Each move as two rows: in at one group, out of another."""
    sides = F.array(F.struct(F.col(into).alias(name), F.lit("in").alias("dir")), F.struct(F.col(out_of).alias(name), F.lit("out").alias("dir")))
    return moves.select(*keep, F.inline(sides))


def flows(moves: DataFrame, keys: list[str], fee: str = "fee", ts: str = "date") -> DataFrame:
    """Fees in and out (undisclosed count 0), moves, the share with a disclosed fee, the latest date."""
    total = lambda d: F.coalesce(F.sum(F.when(F.col("dir") == d, F.col(fee))), F.lit(0.0))
    return moves.groupBy(*keys).agg(
        total("in").alias("fees_in"), total("out").alias("fees_out"), F.count(F.lit(1)).alias("n_moves"),
        (F.count(fee) / F.count(F.lit(1))).alias("disclosed_share"), F.max(ts).alias("last_move"),
    )


def without_own(total: Column, own: Column) -> Column:
    """A group's total less the entity's own part; missing parts count 0."""
    return F.coalesce(total, F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
