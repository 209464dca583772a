"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and \t \n \v \f \r. ``bytes.split()`` cuts at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: on one machine, as in tests, a new folder of our own; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so that what follows survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed Parquet table in that folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4()}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def hot_keys(counts: DataFrame, key: str, n: str, most: int = 1000) -> DataFrame:
    """The keys of ``counts`` (a row a key) that hold more than one in ``most`` of all rows: so at most ``most`` keys, whatever the size."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counts.where(F.col(n) * most > F.lit(max(total, 10 * most))).select(key)


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, salts: int = 32, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (a row a key) on ``key``: rows of the ``hot`` keys, a bounded list, are dealt to ``salts`` tasks each
    by their other columns. ``how`` is inner or left."""
    salt = F.pmod(F.xxhash64(*(c for c in big.columns if c != key)), F.lit(salts)).cast("int")
    hot = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    spread = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    copies = small.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def likely_among(df: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """Rows of ``df`` whose ``key`` has its bit set in a bitmap of the keys of ``ids``: all that are among them, and few others.

    The bitmap is a table of ``bits`` / 32,768 rows of 4 KB, which is what is broadcast, however many ids there are. So a
    join that needs few rows of ``df`` doesn't shuffle the others. (An inner join must follow: a semi join is pushed below.)
    """
    bit = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).cast("bigint")
    maps = ids.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bit", bit).withColumn("_map", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_map")
    return found.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0).select(df.columns)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body`` of a column that is worked out once, however often the body uses it (in loops, too)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(id_col: str, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def few_rows(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches to at most ``n`` rows: what becomes Python objects at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            yield batch.slice(start, n)


def few_items(batches: Iterator[pa.RecordBatch], list_col: str, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each has about ``most`` items in its lists of ``list_col``, and one row at least."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.list_value_length(batch.column(list_col)), 0).to_pylist()):
            if held + n > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut Arrow batches so that each holds about ``most_bytes`` of text, and one row at least."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held + n > most_bytes and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
