"""Market index, targets, value history and later outcomes: everything that reads the value series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C
from .asof import asof_backward, asof_nearest
from .ordered import carried

ALL = "_ALL"


def exact_mean(x: Column) -> Column:
    """The mean of logarithms, summed in decimals: the same to the last bit however rows are dealt, so that builds can be compared."""
    return F.sum(x.cast("decimal(20,16)")).cast("double") / F.count(x)


def market_index(population: DataFrame, series: DataFrame, entity: str, group: str, season: str = "season", asof: str = "asof_date", ts: str = "date", value: str = "value") -> DataFrame:
    """(season, asof_date, group, idx, n): mean log of the population's latest values within the look-back, for all and by group.

    A season has an index if its date is at most 31 days after the latest value. Rows for all have the group ``_ALL``, told
    apart by the grouping and not by a null group.
    """
    data_end = series.agg(F.date_add(F.max(ts), C.INDEX_GRACE_DAYS).alias("_end"))  # one row
    usable = population.crossJoin(F.broadcast(data_end)).where(F.col(asof) <= F.col("_end")).drop("_end")
    latest = asof_backward(usable.select(season, asof, group, entity), series, [entity], asof, ts, [value], lookback_days=C.INDEX_LOOKBACK_DAYS).where(F.col(value).isNotNull())
    return latest.groupingSets([[season, asof], [season, asof, group]], season, asof, group).agg(
        F.grouping(F.col(group)).alias("_all"), exact_mean(F.ln(value)).alias("idx"), F.count(F.lit(1)).alias("n_entities")
    ).select(season, asof, F.when(F.col("_all") == 1, ALL).otherwise(F.col(group)).alias(group), "idx", "n_entities")


def targets(seasons: DataFrame, series: DataFrame, entity: str, season: str = "season", end: str = "end_date", ts: str = "date", value: str = "value", within_days: int = C.TARGET_WINDOW_DAYS, method: str = "segments", keep: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """(entity, season, target_value, target_date, ``keep``): the value nearest to the season's end, the later of two as near."""
    asked = list(dict.fromkeys([entity, season, end, *keep]))
    found = asof_nearest(seasons.select(*asked), series, [entity], F.col(end), ts, {value: "target_value", ts: "target_date"}, within_days, method=method, unique=unique)
    return found.select(entity, season, "target_value", "target_date", *keep)


def value_history(cutoffs: DataFrame, series: DataFrame, entity: str, season: str = "season", start: str = "start_date", cutoff: str = "cutoff", ts: str = "date", value: str = "value", method: str = "segments") -> DataFrame:
    """Last, highest, at the season's start and a year before the cut-off: four as-of values of the values up to the cut-off.

    Each cut-off asks at three points in time. Points and values are sorted by time, once, and the last and the highest
    value so far are carried along: linear in the length of a series. ``window`` sorts an entity in one task, ``segments``
    ranges of entity and time. No value up to the cut-off: no row.
    """
    point = lambda name, at: F.struct(F.lit(name).alias("name"), at.alias("at"))
    points = F.array(point("last", F.col(cutoff)), point("start", F.least(start, cutoff)), point("year", F.date_sub(cutoff, 365)))
    asked = cutoffs.select(F.col(entity).alias("_e"), F.struct(entity, season, cutoff).alias("_probe"), F.explode(points).alias("_p"))
    found = F.struct(F.col(ts).alias("ts"), F.col(value).alias("v"))
    rows = series.where(F.col(ts).isNotNull()).select(F.col(entity).alias("_e"), F.col(ts).alias("_t"), F.lit(0).alias("_tag"), found.alias("_row"))
    none = F.lit(None)
    probes = asked.select("_e", F.col("_p.at").alias("_t"), F.lit(1).alias("_tag"), none.cast(rows.schema["_row"].dataType).alias("_row"), "_probe", F.col("_p.name").alias("_name"))
    rows = rows.withColumns({"_probe": none.cast(probes.schema["_probe"].dataType), "_name": none.cast("string")})
    events = rows.unionByName(probes).withColumn("_tie", F.col("_row"))
    if method == "segments":
        history = carried(events, ["_e"], ["_t", "_tag", "_tie"], "_row", before="_last", most=("v", "_peak"))
    else:
        so_far = Window.partitionBy("_e").orderBy("_t", "_tag", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        history = events.withColumns({"_last": F.last("_row", ignorenulls=True).over(so_far), "_peak": F.max("_row.v").over(so_far)})
    history = history.where("_probe is not null and _last is not null")
    of = lambda name, c: F.max(F.when(F.col("_name") == name, F.col(c)))
    return history.groupBy("_probe").agg(
        of("last", "_last.v").alias("val_last"), of("last", "_last.ts").alias("val_hist_date"), of("last", "_peak").alias("val_peak"), of("start", "_last.v").alias("val_season_start"), of("year", "_last.v").alias("val_12m"),
    ).select(f"_probe.{entity}", f"_probe.{season}", "val_last", "val_hist_date", "val_peak", "val_season_start", "val_12m", F.col(f"_probe.{cutoff}").alias("val_cutoff"))


def outcomes(target: DataFrame, series: DataFrame, entity: str, season: str = "season", ts: str = "date", value: str = "value", within_days: int = C.FUTURE_WINDOW_DAYS, method: str = "segments", unique: bool = False) -> DataFrame:
    """(entity, season, last_update_log_change, future_value, future_date): the step at the target, and the value a year after it."""
    target = target.select(entity, season, "target_value", "target_date")
    before = asof_backward(target, series, [entity], "target_date", ts, [value], strict=True, method="window" if method == "range" else method)
    before = before.select(entity, season, F.ln(F.col("target_value") / F.col(value)).alias("last_update_log_change"))
    after = asof_nearest(target, series, [entity], F.date_add("target_date", 365), ts, {value: "future_value", ts: "future_date"}, within_days, method=method, unique=unique)
    return before.join(after.select(entity, season, "future_value", "future_date"), [entity, season], "left")


def index_at(index: DataFrame, name: str, shift: int = 0, group: str = "league", season: str = "season") -> DataFrame:
    """(season, name): the index for all, ``shift`` seasons later."""
    return index.where(F.col(group) == ALL).select((F.col(season) - shift).alias(season), F.col("idx").alias(name))
