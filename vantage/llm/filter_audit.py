"""How filters act on each other: what each takes away, alone and after others, in every order.

Each filter stores the ids of the rows that fail it. Semi and anti joins with these tables, one filter after the other,
split the rows into at most 2^n classes by the filters they fail: each row stands in one class, so a join with a filter's
table touches every row twice, whatever the number of orders. An order's prefixes are then semi and anti joins over the
classes, which are few, weighted by their rows.
"""

from __future__ import annotations

from itertools import permutations
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, checkpoint_dir, cut, hot_keys, let, salted_join, written

COPIES = "E"


def rules(text: Column) -> Column:
    """The letters of the filters that a text fails by itself: A short, B few different words, C many capitals, D symbols."""
    words = F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")
    capitals, length = F.regexp_count(text, F.lit("[A-Z]")).cast("bigint"), F.length(text).cast("bigint")

    def failed(ws: Column) -> Column:
        n, distinct = F.size(ws).cast("bigint"), F.size(F.array_distinct(ws)).cast("bigint")
        found = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * length, "D": text.rlike("[#$%&*|]")}
        return F.concat_ws("", *(F.when(bad, F.lit(letter)) for letter, bad in found.items()))

    return let(words, failed)


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows (row) whose text, by its SHA-256, a row with a smaller id has too. Rows without id neither fail nor make others fail."""
    ids = rows.where("doc_id is not null")
    first = written(ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last"))
    joined = salted_join(ids.select("sha", "row", "doc_id"), first.select("sha", "first"), "sha", hot_keys(first, "sha", "n"))
    return joined.where("doc_id > first").select("row")


def failing_ids(rows: DataFrame, letters: str) -> dict[str, DataFrame]:
    """One stored table of ids (row) for each filter: a folder each of one Parquet table."""
    spark = rows.sparkSession
    own = rows.select("row", F.explode(F.filter(F.split("fails", ""), lambda x: x != "")).alias("filter"))
    copies = later_copies(rows).withColumn("filter", F.lit(COPIES))
    path = f"{checkpoint_dir(spark)}/failing-{uuid4()}"
    own.unionByName(copies).write.partitionBy("filter").parquet(path, compression="zstd")
    stored = spark.read.schema("row bigint, filter string").parquet(path)
    return {f: stored.where(F.col("filter") == f).select("row") for f in letters}


def failure_classes(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, failed, n, good, toxic): rows by the filters they fail, ``failed`` being those filters' letters in order."""
    level = rows.select("row", "part", "good", "toxic", F.lit("").alias("failed"))
    for letter, ids in failing.items():
        hit = level.join(ids, "row", "left_semi").withColumn("failed", F.concat("failed", F.lit(letter)))
        level = cut(hit.unionByName(level.join(ids, "row", "left_anti")))
    return level.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def in_all_orders(rows: DataFrame, letters: str) -> DataFrame:
    """Each row with every order of the filters and every step of it: filter_order, step, filter, and the letters ``before``."""
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters))))
    steps = rows.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    return steps.select("*", F.expr("substring(filter_order, step, 1)").alias("filter"), F.expr("substring(filter_order, 1, step - 1)").alias("before"))


def audit_orders(classes: DataFrame, letters: str) -> DataFrame:
    """The report of ``audit_filters`` from rows by class. The relations that are broadcast have at most n! n 2^n rows, whatever the data."""
    letter = F.explode(F.filter(F.split("failed", ""), lambda x: x != ""))
    failing = classes.select("failed").distinct().select("failed", letter.alias("filter"))
    lost = in_all_orders(failing.withColumnRenamed("filter", "own"), letters).where("instr(before, own) > 0").select("filter_order", "step", "failed").distinct()
    lost, failing, prefix, on = F.broadcast(lost), F.broadcast(failing), ["filter_order", "step", "failed"], ["failed", "filter"]
    faced = in_all_orders(classes, letters).drop("before")
    survivors, gone = faced.join(lost, prefix, "left_anti"), faced.join(lost, prefix, "left_semi")
    found = {
        "kept": survivors.join(failing, on, "left_anti"), "removed": survivors.join(failing, on, "left_semi"), "redundant": gone.join(failing, on, "left_semi"), "": faced,
    }
    told = None
    for name, rows in found.items():
        value = lambda x, c="n", of=name: (F.col(c) if x == of else F.lit(0)).alias(x)
        part = rows.select(
            "part", "filter_order", "step", "filter", *map(value, ("kept", "removed", "redundant")), (F.when(F.col("failed") == F.col("filter"), F.col("n")).otherwise(0) if not name else F.lit(0)).alias("unique_fails"),
            *((F.col(c) if name == "removed" else F.lit(0)).alias(f"{c}_lost") for c in ("good", "toxic")),
        )
        told = part if told is None else told.unionByName(part)
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    report = told.groupBy("part", "filter_order", "step", "filter").agg(*(F.sum(m).cast("bigint").alias(m) for m in measures))
    share = F.sum("removed").over(Window.partitionBy("part", "filter"))  # n! rows
    return report.select("part", "filter_order", F.col("step").cast("int").alias("step"), *measures, share.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the filters.

    A: under 200 words. B: fewer different words than half of them. C: over 3 % of the code points in A-Z. D: any of
    ``#$%&*|``. E: identical to the text of a row with a smaller id, removed or not (SHA-256 stands for the text). ``letters``
    may leave filters out.

    Null texts are empty; null parts are the empty string. A row is good (toxic) if any label of its id says so; rows
    without id have no labels and never fail E. Rows that share an id are rows of their own, and aren't earlier than each
    other. An empty table gives no rows; parts without failures give zeros. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("bigint"), F.lit(0)))
    marks = labels.select(F.col("doc_id").alias("_id"), "quality", "toxic").where("_id is not null").groupBy("_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    read = docs.select("doc_id", "part", F.sha2("text", 256).alias("sha"), rules(F.col("text")).alias("fails"))
    rows = written(read.withColumn("row", F.monotonically_increasing_id()))
    failing = failing_ids(rows, letters)
    named = rows.select("row", "part", "doc_id").join(marks, F.col("doc_id") == F.col("_id"), "left")
    named = named.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return audit_orders(cut(failure_classes(named, failing)), letters)
