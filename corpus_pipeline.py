"""From raw documents to token ids: toxicity, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.llm import decontamination, near_dedup, sentencepiece_codec, substring_dedup, toxicity
from vantage.llm.common import checkpoint_dir, fresh_name, read_table

#: Rows of an Arrow batch at most. With Spark's 10,000 a task holds tens of MB of texts at a time in its Python worker, and as much outside the JVM's heap.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with batches of at most ``BATCH_ROWS`` rows. The setting stays with the session, since what a stage returns is run after it."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Rows with a null or empty text or a null id are judged as ``score_toxicity`` says; equal rows alike."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: the one with the smallest id (rows without id last), then the least text.

    Each row is judged by its own text, also where rows share an id. Rows with a null text stay; empty texts are equal texts.
    """
    node, nth = fresh_name(docs, "node"), fresh_name(docs, "nth")
    _, labels = near_dedup.text_classes(docs)
    named = docs.withColumn(node, near_dedup.node_of(F.col("text")))
    ids = named.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("id"))
    classes = ids.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label"))
    kept = classes.agg(F.min_by(F.struct("id", "node"), F.struct(F.col("id").isNull(), "id", "node")).alias("one")).select("one.id", "one.node")
    same = named["doc_id"].eqNullSafe(kept["id"]) & (named[node] == kept["node"])
    one = named.join(kept, same, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", node).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return one.select(docs.columns).unionByName(docs.where("text is null"))


@in_small_batches
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; a document of which nothing is left goes.

    Earlier is what has a smaller id. Rows without id, with null, empty or short texts stay as they are; of rows that
    share an id only those lose a passage that have it.
    """
    return substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs))


@in_small_batches
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by its own text, with or without id; null and empty texts stay."""
    key = fresh_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = decontamination.contaminated_documents(keyed, read_table(spark, sf_dir, "benchmark"), id_col=key)
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, parity, round_trip of every row; null and empty texts have no tokens."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("tokens", encode),
]

#: Learned models and iterative joins have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read again."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
