"""Order over whole groups without a task that holds a whole group: places, shared ranks, values carried along.

Rows are dealt by ranges of (group, order). A segment is what lies between two cuts, which Spark draws so that segments are
about equal: a large group lies in many segments, small ones share one. Windows work inside a segment and group. What a
segment has to know of the others (rows before it, the last value seen, a run of equal values that goes on) is one row a
segment and group; it is worked out over that small table and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.relations import stored

SEG, GROUP = "_seg", "_group"
LARGE = 1_000_000  # rows of a group that one task sorts; larger groups are dealt to several
CODES = 1 << 16


def segmented(df: DataFrame, by: list[str], order: list[Column], segments: int | None = None) -> DataFrame:
    """``df`` with its group as a struct and the number of its segment, stored: later passes see the same cuts."""
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = df.withColumn(GROUP, F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("all")))
    return stored(grouped.repartitionByRange(n, F.col(GROUP), *order).withColumn(SEG, F.spark_partition_id()))


def _before(column: str, how) -> Column:
    """``how`` over the rows of all earlier segments of the group, in a table of a row a segment and group."""
    return how(column).over(Window.partitionBy(GROUP).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1))


def large_groups(df: DataFrame, by: list[str], most: int = LARGE) -> DataFrame | None:
    """The groups (as structs) of more than ``most`` rows; None if there are none.

    Rows are counted by a hash of their group first, a few numbers a task: only where a hash has more are groups counted.
    """
    code = F.pmod(F.xxhash64(*by), F.lit(CODES))
    full = [r["code"] for r in df.groupBy(code.alias("code")).count().where(F.col("count") > most).collect()]  # CODES at most
    if not full:
        return None
    groups = df.where(code.isin(full)).groupBy(F.struct(*(F.col(b) for b in by)).alias(GROUP)).count()
    groups = stored(groups.where(F.col("count") > most).select(GROUP))
    return None if groups.isEmpty() else groups


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position", segments: int | None = None) -> DataFrame:
    """``df`` with each row's place in its group from 1. ``order`` must tell rows apart where the place shall not depend on chance."""
    rows = segmented(df, by, order, segments)
    counts = rows.groupBy(SEG, GROUP).agg(F.count(F.lit(1)).alias("_n")).withColumn("_earlier", F.coalesce(_before("_n", F.sum), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(SEG, GROUP).orderBy(*order))
    placed = rows.withColumn(name, inside).join(counts.drop("_n"), [SEG, GROUP])
    return placed.withColumn(name, F.col("_earlier") + F.col(name)).select(*df.columns, name)


def average_ranks(df: DataFrame, by: list[str], value: str, key: str, name: str, segments: int | None = None) -> DataFrame:
    """``df`` with each row's rank by ``value`` in its group from 1, equal values sharing the mean of their places. Nulls are left out.

    ``key`` only deals equal values to segments. A value that a segment begins or ends with may go on in others; those, two a
    segment and group at most, are counted over all segments.
    """
    rows = segmented(df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double") + 0.0), by, [F.col("_v"), F.col(key)], segments)
    own = Window.partitionBy(SEG, GROUP)
    ranked = rows.withColumns({"_lo": F.rank().over(own.orderBy("_v")).cast("bigint"), "_same": F.count(F.lit(1)).over(own.orderBy("_v").rangeBetween(0, 0))})
    run = F.struct("_v", "_lo", "_same")
    ends = ranked.groupBy(SEG, GROUP).agg(F.count(F.lit(1)).alias("_n"), F.min(run).alias("_first"), F.max(run).alias("_last"))
    ends = stored(ends.withColumn("_earlier", F.coalesce(_before("_n", F.sum), F.lit(0))).withColumn("_runs", F.array_distinct(F.array("_first", "_last"))))
    runs = ends.select(SEG, GROUP, "_earlier", F.explode("_runs").alias("_run")).select(SEG, GROUP, F.col("_run._v").alias("_v"), (F.col("_earlier") + F.col("_run._lo")).alias("_start"), F.col("_run._same").alias("_same"))
    whole = runs.groupBy(GROUP, "_v").agg(F.min("_start").alias("_start"), F.sum("_same").alias("_total"))
    known = runs.select(SEG, GROUP, "_v").join(whole, [GROUP, "_v"]).groupBy(SEG, GROUP).agg(F.map_from_entries(F.collect_list(F.struct("_v", F.struct("_start", "_total")))).alias("_known"))  # two at most
    state = ends.select(SEG, GROUP, "_earlier").join(known, [SEG, GROUP])
    joined = ranked.join(state, [SEG, GROUP]).withColumn("_run", F.try_element_at("_known", F.col("_v")))
    start, total = F.coalesce("_run._start", F.col("_earlier") + F.col("_lo")), F.coalesce("_run._total", F.col("_same"))
    return joined.withColumn(name, start + (total - 1) / 2).select(*df.columns, name)


def carried(
    events: DataFrame, by: list[str], order: list[str], payload: str, before: str | None = None, after: str | None = None, most: tuple[str, str] | None = None, segments: int | None = None,
    large: int = LARGE,
) -> DataFrame:
    """``events`` with the last ``payload`` that isn't null at or before each row, and the first at or after it, as columns ``before`` and ``after``.

    Payloads are structs. ``order`` are columns that hold no nulls where there is a payload. ``most`` (a field of the payload,
    a name) asks for the field's greatest value at or before each row. Groups of at most ``large`` rows are windows in the
    task that has them: one shuffle by group, nothing stored. Larger ones are dealt to segments. With ``segments``, a number
    of them, all groups are.
    """
    if segments or not by:
        return _carried_on(events, by, order, payload, before, after, most, segments)
    wide = large_groups(events.select(*by), by, large)
    if wide is None:
        return _carried_inside(events, by, order, payload, before, after, most)
    keyed = events.withColumn(GROUP, F.struct(*(F.col(b) for b in by)))
    inside = _carried_inside(keyed.join(wide, GROUP, "left_anti").select(*events.columns), by, order, payload, before, after, most)
    return inside.unionByName(_carried_on(keyed.join(wide, GROUP, "left_semi").select(*events.columns), by, order, payload, before, after, most, None))


def _carried_inside(events: DataFrame, by: list[str], order: list[str], payload: str, before: str | None, after: str | None, most: tuple[str, str] | None) -> DataFrame:
    """``carried`` for groups that fit into a task."""
    own, out = Window.partitionBy(*by), events
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if most:
        out = out.withColumn(most[1], F.max(f"{payload}.{most[0]}").over(so_far(own.orderBy(*order))))
    for name, directed in ((before, [F.asc(c) for c in order]), (after, [F.desc(c) for c in order])):
        if name:
            out = out.withColumn(name, F.last(payload, ignorenulls=True).over(so_far(own.orderBy(*directed))))
    return out.select(*events.columns, *([most[1]] if most else []), *(n for n in (before, after) if n))


def _carried_on(events: DataFrame, by: list[str], order: list[str], payload: str, before: str | None, after: str | None, most: tuple[str, str] | None, segments: int | None) -> DataFrame:
    """``carried`` for groups of any size. Each direction is one sorted pass over a segment; a group's segments hand what they end
    (begin) with, and their greatest value, to the next (the one before).
    """
    rows = segmented(events, by, [F.col(c) for c in order], segments)
    own, there = Window.partitionBy(SEG, GROUP), F.col(payload).isNotNull()
    at = F.when(there, F.struct(*order, payload))
    greatest = F.max(f"{payload}.{most[0]}") if most else F.lit(None)
    ends = rows.groupBy(SEG, GROUP).agg(F.max(at).alias("_end"), F.min(at).alias("_begin"), greatest.alias("_most"))
    along = Window.partitionBy(GROUP).rowsBetween(Window.unboundedPreceding, -1)
    handed = lambda c, o: F.last(c, ignorenulls=True).over(along.orderBy(o))[payload]
    state = ends.select(SEG, GROUP, handed("_end", F.asc(SEG)).alias("_from_before"), handed("_begin", F.desc(SEG)).alias("_from_after"), _before("_most", F.max).alias("_most_before"))
    found = {}
    if most:
        so_far = F.max(f"{payload}.{most[0]}").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows, found[most[1]] = rows.withColumn("_most_here", so_far), F.greatest("_most_here", "_most_before")
    for name, directed, rest in ((before, [F.asc(c) for c in order], "_from_before"), (after, [F.desc(c) for c in order], "_from_after")):
        if name:
            nearest = F.last(payload, ignorenulls=True).over(own.orderBy(*directed).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            rows, found[name] = rows.withColumn(f"_near{rest}", nearest), F.coalesce(f"_near{rest}", rest)
    return rows.join(state, [SEG, GROUP]).withColumns(found).select(*events.columns, *found)
