"""Jump consistent hashing (Lamping and Veach, 2014) in DataFrame expressions.

A stable 64-bit key and the number of shards decide the shard; there is no ring table. Going from n to n + 1
shards moves about one key in n + 1, each of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: the multiplier of its 64-bit linear congruential generator (the increment is 1).
LCG_MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, on two halves of 32 bits each; no product here passes 2**63, as ANSI mode asks."""
    m_hi, m_lo = LCG_MULTIPLIER >> 32, LCG_MULTIPLIER & LOW32
    upper = F.shiftright(lo, 16) * F.lit(m_lo)
    low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_lo) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    from_hi = hi.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_lo) + F.shiftleft((F.shiftright(hi, 16) * F.lit(m_lo)).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(upper, 16) + F.shiftright(low, 32) + (lo * F.lit(m_hi)).bitwiseAND(F.lit(LOW32)) + from_hi
    return high.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_hash(key: Column, n_shards: int) -> Column:
    """Struct of ``shard`` (of ``n_shards``) and ``grown_shard`` (of one more) for a bigint key; a null key counts as 0.

    The jumps go upwards until they pass the last shard: about ln(n) of the at most n + 1 steps do any work.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.lit(0).cast("bigint").alias("jump"), F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown_shard"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        # the upper 31 bits, plus 1, as a share of 2**31
        far = F.floor((s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(s["jump"] > n_shards, s).otherwise(
            F.struct(
                hi.alias("hi"), lo.alias("lo"), far.alias("jump"),
                F.when(s["jump"] < n_shards, s["jump"]).otherwise(s["shard"]).alias("shard"), s["jump"].alias("grown_shard"),
            )
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n_shards)), start, step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown_shard"].cast("int").alias("grown_shard")),
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 200_000) -> DataFrame:
    """Every document's shard by the law ``key``, and its slot in the shard (0, 1, 2, ... without gaps).

    Slots: a shard is cut into cells by a hash of the row; rows are numbered within a cell, and a running sum over the
    cells' counts (one small row a cell, the number of cells follows the number of rows) says where each cell begins.
    So no task holds a shard. Only id, size and checksum are shuffled, never texts.

    Ids are integers, or texts of integers. Null id: key 0. Null text: size 8, the checksum of no bytes. Repeated rows each get a row and a slot of their own.
    Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_hash(F.col(id_col), n_shards).alias("place"),
    )
    n_cells = max(1, -(-docs.count() // (cell_rows * n_shards)))
    cell = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_cells)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", F.col("place.shard").alias("shard"), F.col("place.grown_shard").alias("grown_shard")).withColumn("cell", cell)
    starts = rows.groupBy("shard", "cell").count().select(
        "shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("start")
    )
    order = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard",
        )
    )
