"""As-of joins: the value of a series at, before or nearest to a point in time.

Three forms with equal results. ``range`` joins on the key with the time bound as a residual and keeps the best match: good
where a probe meets few rows. ``window`` unions probes and series, sorts by time within the key and carries values along:
one shuffle and linear output, whatever the length of the series. ``segments`` does so over ranges of (key, time) that hand
on what they end with: a key that holds much of the table lies in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried


def asof_backward(
    probes: DataFrame, series: DataFrame, by: list[str], at: str, ts: str, values: list[str], strict: bool = False, lookback_days: int | None = None,
    method: str = "window",
) -> DataFrame:
    """``probes`` with the latest row of ``series`` at or before ``at`` (before, if strict), no older than the look-back.

    The look-back is half open: (at - days, at]. Ties of time take the largest values. No match gives nulls. A null key or
    ``at`` matches nothing. The series' time comes back under its own name.
    """
    payload = F.struct(F.col(ts), *(F.col(v) for v in values))
    series = series.select(*by, payload.alias("_row")).where(F.col(f"_row.{ts}").isNotNull())
    if method == "range":
        keyed = probes.withColumn("_probe", F.monotonically_increasing_id())
        bound = (F.col(f"_row.{ts}") < F.col(at)) if strict else (F.col(f"_row.{ts}") <= F.col(at))
        if lookback_days is not None:
            bound &= F.col(f"_row.{ts}") > F.date_sub(F.col(at), lookback_days)
        right = series.select(*(F.col(b).alias(f"_{b}") for b in by), "_row")
        joined = keyed.join(right, [F.col(b) == F.col(f"_{b}") for b in by] + [bound], "left")
        best = joined.groupBy("_probe", *probes.columns).agg(F.max("_row").alias("_row"))
        return best.select(*probes.columns, f"_row.{ts}", *(f"_row.{v}" for v in values))
    if method not in ("window", "segments"):
        raise ValueError(f"no form of as-of join is called {method!r}")
    events = _events(probes, series, by, F.col(at), ts, strict)
    if method == "segments":
        found = carried(events, by, ["_t", "_tag", "_tie"], "_row", before="_before").where("_probe is not null").withColumn("_row", F.col("_before"))
    else:
        order = Window.partitionBy(*by).orderBy("_t", "_tag", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = events.withColumn("_row", F.last("_row", ignorenulls=True).over(order)).where("_probe is not null")
    usable = F.col("_t").isNotNull()
    for b in by:
        usable &= F.col(b).isNotNull()
    if lookback_days is not None:
        usable &= F.col(f"_row.{ts}") > F.date_sub(F.col("_t"), lookback_days)
    row = F.when(usable, F.col("_row"))
    return found.select("_probe.*", row.alias("_row")).select(*probes.columns, f"_row.{ts}", *(f"_row.{v}" for v in values))


def _events(probes: DataFrame, series: DataFrame, by: list[str], at: Column, ts: str, strict: bool = False) -> DataFrame:
    """Probes and series rows (``_row``, else null) as one table by time. Series rows stand before probes of the same time, unless the join is strict."""
    tag = 1 if strict else 0
    empty = F.lit(None).cast(series.schema["_row"].dataType)
    left = probes.select(*by, at.alias("_t"), F.lit(1 - tag).alias("_tag"), empty.alias("_row"), F.struct(*probes.columns).alias("_probe"))
    right = series.select(*by, F.col(f"_row.{ts}").alias("_t"), F.lit(tag).alias("_tag"), "_row", F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"))
    return left.unionByName(right).withColumn("_tie", F.col("_row"))


def nearest_key(at: Column, ts: Column, prefer_later: bool = True) -> Column:
    """Smaller is nearer; of two at the same distance the later (or the earlier) is."""
    later = F.when(ts > at, 1).otherwise(0)
    return F.abs(F.datediff(ts, at)) * 2 - (later if prefer_later else 1 - later)


def asof_nearest(
    probes: DataFrame, series: DataFrame, by: list[str], at: Column, ts: str, values: dict[str, str], within_days: int, prefer_later: bool = True,
    method: str = "segments", unique: bool = False,
) -> DataFrame:
    """``probes`` and the series' ``values`` (name -> new name) nearest to the date ``at``; probes without a match are left out.

    Of rows of the same date the smallest values are taken; ``unique`` says that there are no such rows. Null keys, dates and probes' dates match nothing. ``range`` meets
    all rows within the days; ``segments`` takes the last row up to the date and the first after it, whatever the days.
    """
    source = lambda v, name: F.col(ts if v == ts else v).alias(name)
    known = series.where(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_ts"), F.struct(*(source(v, n) for v, n in values.items())).alias("_v"))
    if method == "range":
        right = known.select(*(F.col(b).alias(f"_{b}") for b in by), "_ts", "_v")
        joined = probes.withColumns({"_at": at, "_probe": F.monotonically_increasing_id()}).join(
            right, [F.col(b) == F.col(f"_{b}") for b in by] + [F.col("_ts").between(F.date_sub("_at", within_days), F.date_add("_at", within_days))]
        )
        best = F.min_by("_v", F.struct(nearest_key(F.col("_at"), F.col("_ts"), prefer_later), "_v"))
        return joined.groupBy("_probe", *probes.columns).agg(best.alias("_b")).select(*probes.columns, "_b.*")
    if method != "segments":
        raise ValueError(f"no form of nearest join is called {method!r}")
    one = (known if unique else known.groupBy(*by, "_ts").agg(F.min("_v").alias("_v"))).select(*by, F.struct("_ts", "_v").alias("_row"))
    events = _events(probes, one, by, at, "_ts")
    found = carried(events, by, ["_t", "_tag", "_tie"], "_row", before="_before", after="_after").where("_probe is not null and _t is not null")
    for b in by:
        found = found.where(F.col(b).isNotNull())
    far = lambda c: nearest_key(F.col("_t"), F.col(f"{c}._ts"), prefer_later)
    near = F.array_min(F.filter(
        F.array(*(F.struct(far(c).alias("far"), F.abs(F.datediff(f"{c}._ts", "_t")).alias("days"), F.col(f"{c}._v").alias("v")) for c in ("_before", "_after"))), lambda x: x["days"] <= within_days,
    ))
    return found.select("_probe", near.alias("_near")).where("_near is not null").select("_probe.*", "_near.v.*")
