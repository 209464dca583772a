"""Exact order statistics of whole groups: the value at a place, quantiles, the rows that are among the first k.

No group is sorted or gathered. Each round counts the values of every open bracket in bins, keeps the bin that holds the
wanted place and narrows the bracket to the least and greatest value in it. What is shuffled are counts. A bracket with few
rows left is sorted as it is; one whose ends are equal is done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.relations import stored
from .ordered import GROUP, positions

BINS = 256
SMALL = 4096  # rows of a bracket that are sorted at once
FEW = 50_000  # brackets that are handed to every task


def _group(by: list[str]) -> Column:
    return F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("all"))


def _among(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows (group, v) in each open bracket of their group. Brackets go to every task where they are few, else they are joined by group."""
    brackets = open_.select(GROUP, "lo", "hi").distinct()
    side = F.broadcast(brackets) if open_.count() <= FEW else brackets
    return rows.join(side, GROUP).where("v >= lo and v <= hi")


def _bin(logarithmic: bool) -> Column:
    """The bin of v between lo and hi. Rounding doesn't matter: a greater value never has a smaller bin, lo has the first and hi the last."""
    x = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if logarithmic else (lambda c: F.col(c) / 2)
    at = (x("v") - x("lo")) / F.nullif(x("hi") - x("lo"), F.lit(0.0)) * BINS
    return F.coalesce(F.least(F.floor(at), F.lit(BINS - 1)), F.lit(0)).cast("int")


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(by, position, value): the ``position``-th smallest value of a group, from 1, for each row of ``wanted`` (by, position).

    Nulls and values that aren't finite don't count; places beyond the group's end give no row. Values are taken as doubles.
    Rounds are linear and logarithmic in turn, so neither a long tail nor values far from 0 take many.
    """
    v = F.col(value).cast("double") + 0.0
    rows = df.select(_group(by).alias(GROUP), v.alias("v")).where(F.abs("v") < float("inf"))
    spans = rows.groupBy(GROUP).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
    open_ = wanted.select(_group(by).alias(GROUP), F.col("position").cast("bigint").alias("position")).distinct().join(spans, GROUP)
    open_ = open_.where("position between 1 and inside").withColumn("below", F.lit(0).cast("bigint"))
    done, turn = [], 0
    while True:
        open_ = stored(open_)
        done.append(open_.where("lo = hi").select(GROUP, "position", F.col("lo").alias("value")))
        few = open_.where(f"lo < hi and inside <= {SMALL}")
        if not few.isEmpty():
            lists = _among(rows, few).groupBy(GROUP, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
            done.append(few.join(lists, [GROUP, "lo", "hi"]).select(GROUP, "position", F.element_at("sorted", (F.col("position") - F.col("below")).cast("int")).alias("value")))
        open_ = open_.where(f"lo < hi and inside > {SMALL}")
        if open_.isEmpty():
            break
        open_ = _narrowed(rows, open_, turn % 2 == 1)
        turn += 1
    found = reduce(DataFrame.unionByName, done)
    return found.select(*(F.col(f"{GROUP}.{b}").alias(b) for b in by), "position", "value")


def _narrowed(rows: DataFrame, open_: DataFrame, logarithmic: bool) -> DataFrame:
    bins = _among(rows, open_).groupBy(GROUP, "lo", "hi", _bin(logarithmic).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    so_far = F.sum("n").over(Window.partitionBy(GROUP, "lo", "hi").orderBy("bin"))  # BINS rows at most
    bins = bins.withColumn("through", so_far)
    place = F.col("position") - F.col("below")
    hit = open_.drop("inside").join(bins, [GROUP, "lo", "hi"]).where((place <= F.col("through")) & (place > F.col("through") - F.col("n")))
    return hit.select(GROUP, "position", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("n").alias("inside"), (F.col("below") + F.col("through") - F.col("n")).alias("below"))


def quantiles(df: DataFrame, by: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """(by, n, a column for each name of ``asked``): linearly interpolated quantiles of the values that aren't null."""
    v = F.col(value).cast("double")
    known = df.select(*by, v.alias("_v")).where(F.abs("_v") < float("inf"))
    counts = stored(known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))) if by else stored(known.agg(F.count(F.lit(1)).alias("n")))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    asked_rows = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.floor(place(q)) + 1).alias("low"), (F.ceil(place(q)) + 1).alias("high"), (place(q) - F.floor(place(q))).alias("part")) for name, q in asked.items())))
    wanted = counts.where("n > 0").select(*by, "n", asked_rows.alias("q")).select(*by, "n", "q.*")
    found = order_statistics(known, by, "_v", wanted.select(*by, F.explode(F.array("low", "high")).alias("position")))
    key = lambda df, *c: df.select(_group(by).alias(GROUP), *c)
    at = key(found, "position", "value")
    both = key(wanted, "name", "low", "high", "part").join(at.withColumnsRenamed({"position": "low", "value": "_low"}), [GROUP, "low"]).join(at.withColumnsRenamed({"position": "high", "value": "_high"}), [GROUP, "high"])
    wide = both.groupBy(GROUP).agg(*(F.max(F.when(F.col("name") == name, F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("part"))).alias(name) for name in asked))
    return key(counts, *by, "n").join(wide, GROUP, "left").select(*by, "n", *asked)


def medians(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, a median for each name of ``values``), all found in the same rounds."""
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("_name"), c.cast("double").alias("_value")) for name, c in values.items())))
    found = quantiles(df.select(*by, each), [*by, "_name"], "_value", {"_median": 0.5})
    wide = [F.max(F.when(F.col("_name") == name, F.col("_median"))).alias(name) for name in values]
    return found.groupBy(*by).agg(*wide) if by else found.agg(*wide)


def top_k(df: DataFrame, by: list[str], score: str, key: str, sizes: DataFrame) -> DataFrame:
    """``df`` with the columns of ``sizes`` (by, size and what names it) for each of its group's sizes, and ``chosen``: whether the
    row is among the first ``size`` by falling score. Equal scores are taken in the order of ``key``; rows without a score never are.

    The score at place ``size`` is an order statistic; rows above it are chosen, and of those equal to it, if not all, the
    first by key. Only these are dealt by their order.
    """
    names = [c for c in sizes.columns if c not in by]
    s = F.col(score).cast("double") + 0.0
    counts = df.where(F.abs(s) < float("inf")).groupBy(_group(by).alias(GROUP)).agg(F.count(F.lit(1)).alias("_n"))
    asked = stored(sizes.withColumn(GROUP, _group(by)).join(counts, GROUP, "left").withColumn("_place", F.greatest(F.coalesce("_n", F.lit(0)) - F.col("size") + 1, F.lit(1))))
    found = order_statistics(df, by, score, asked.select(*by, F.col("_place").alias("position")))
    limits = asked.drop(*by).join(found.select(_group(by).alias(GROUP), F.col("position").alias("_place"), F.col("value").alias("_limit")), [GROUP, "_place"], "left")
    limits = stored(limits.select(GROUP, *names, "_limit"))
    spread = df.withColumn(GROUP, _group(by)).join(F.broadcast(limits) if limits.count() <= FEW else limits, GROUP)
    spread = spread.withColumn("_tie", F.coalesce((s == F.col("_limit")) & (F.col("size") > 0), F.lit(False)))
    above = F.coalesce((s > F.col("_limit")) & (F.col("size") > 0), F.lit(False))
    tallies = spread.groupBy(GROUP, *names).agg(F.count_if(above).alias("_above"), F.count_if("_tie").alias("_tied"))
    open_ = stored(tallies.where("_above + _tied > size").select(GROUP, *names, (F.col("size") - F.col("_above")).alias("_room")))
    chosen = spread.withColumn("chosen", above | F.col("_tie"))
    if open_.isEmpty():
        return chosen.select(*df.columns, *names, "chosen")
    # ties that don't all fit: placed by key, the first ones stay
    labels = [GROUP, *names]
    side = F.broadcast(open_) if open_.count() <= FEW else open_
    marked = chosen.join(side, labels, "left")
    settled = marked.where("_room is null or not _tie").select(*df.columns, *names, "chosen")
    placed = positions(marked.where("_room is not null and _tie"), labels, [F.col(key)], "_at")
    return settled.unionByName(placed.withColumn("chosen", F.col("_at") <= F.col("_room")).select(*df.columns, *names, "chosen"))
