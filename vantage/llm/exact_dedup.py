"""Exact duplicates without a task that sees a whole group of copies.

Rows are combined three times: inside the task that read them, by digest and a salt of that task, and by digest over the
salts. A group of copies sends one row a task to the second step and one row a salt to the third, however large it is.
Each step compares whole contents, so a digest only says where equal texts meet, never that they are equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, likely_among, salted_join, written

SPACES = " \t\n\x0b\x0c\r"
SALTS = 16


def content_of(text: Column) -> Column:
    """The text without its six kinds of white space; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def content_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(key, content, best, n) of rows (key, content, n_chars, doc_id): how many rows have a content, and which of them stays.

    ``best`` orders by most code points, then rows with an id, then the smallest id.
    """
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    dealt = rows.select("key", "content", order.alias("best"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = dealt.groupBy("key", "salt", "content").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("key", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _decided(members: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Members (row, doc_id, n_chars, sha, ``by``) with their group's keep_id and group_size; of equal winners the first row stays."""
    at = members.groupBy(by, "doc_id", "n_chars").agg(F.min("row").alias("keep_row")).select(F.col(by).alias("_by"), F.col("doc_id").alias("_id"), F.col("n_chars").alias("_n"), "keep_row")
    same = (groups[by] == at["_by"]) & groups["best.doc_id"].eqNullSafe(at["_id"]) & (-groups["best.less"] == at["_n"])
    winners = groups.join(at, same).select(by, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "keep_row")
    joined = salted_join(members, winners, by, hot_keys(groups, by, "n"), how="left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when they are identical without white space. Of equal texts the row with most code points stays, then
    the one with the smallest id (rows without id last); of rows equal in both one stays, so a group keeps exactly one row.
    ``text_sha256`` is of the text without white space. The digest that brings texts together is its first
    ``digest_chars`` characters; other texts with the same digest are told apart by their contents.

    Texts are read twice: for narrow rows of digests, and again where a digest occurs twice or more. Which those are is
    handed on as a bitmap of 8 MB at most; where it is too full to tell, more texts are compared, with the same result.
    Null and blank texts are equal to each other. Repeated rows and repeated or null ids are rows like others. Empty
    table: no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def keyed(df: DataFrame) -> DataFrame:
        df = df.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), content_of(F.col("text")).alias("content"))
        return df.withColumn("sha", F.sha2("content", 256)).withColumn("key", F.substring("sha", 1, digest_chars))

    members = written(keyed(docs).select("doc_id", "n_chars", "sha", "key").withColumn("row", F.monotonically_increasing_id()))
    shared = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = keyed(likely_among(docs, "doc_id", likely_among(members, "key", shared).select("doc_id")))
    texts = likely_among(again, "key", shared)
    groups = written(content_groups(texts, salts).drop("content"))
    mixed = written(groups.groupBy("key").count().where("count > 1").select("key"))  # digests of several contents: none, as a rule
    if mixed.isEmpty():
        return _decided(members, groups, "key")
    apart = written(texts.join(mixed, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()))
    plain, whole = members.join(mixed, "key", "left_anti"), groups.join(mixed, "key", "left_anti")
    own = content_groups(apart, salts)
    return _decided(plain, whole, "key").unionByName(_decided(apart, own, "content"))
