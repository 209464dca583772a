"""The eight input relations: typed CSV reading with an as-of cut, and the sinks and sources of results."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_PARTITION = 250_000

# Columns and types of each relation, and its column of dates for the as-of cut (fixed by the data).
RELATIONS: dict[str, tuple[str, str | None]] = {
    "players": (
        "player_id bigint, name string, date_of_birth timestamp, position string, sub_position string, foot string, height_in_cm double, "
        "country_of_citizenship string, contract_expiration_date timestamp", None,
    ),
    "clubs": ("club_id bigint, name string, domestic_competition_id string", None),
    "competitions": ("competition_id string, name string, type string, country_name string", None),
    "games": (
        "game_id bigint, competition_id string, season bigint, date date, home_club_id bigint, away_club_id bigint, home_club_goals bigint, "
        "away_club_goals bigint, home_club_position bigint, away_club_position bigint, competition_type string", "date",
    ),
    "appearances": (
        "game_id bigint, player_id bigint, player_club_id bigint, date date, competition_id string, yellow_cards bigint, red_cards bigint, "
        "goals bigint, assists bigint, minutes_played bigint", "date",
    ),
    "game_lineups": ("game_id bigint, player_id bigint, club_id bigint, date date, type string, position string, team_captain bigint", "date"),
    "player_valuations": ("player_id bigint, date date, market_value_in_eur bigint, player_club_domestic_competition_id string", "date"),
    "transfers": ("player_id bigint, transfer_date date, transfer_season string, from_club_id bigint, to_club_id bigint, transfer_fee double", "transfer_date"),
}


def as_of(df: DataFrame, date_col: str | None, cutoff) -> DataFrame:
    """Rows dated up to ``cutoff``; everything if there is no cut-off or no date. Rows without a date go only if there is one."""
    return df if cutoff is None or date_col is None else df.where(F.col(date_col) <= F.lit(cutoff).cast("date"))


def read_relation(spark: SparkSession, folder: str, name: str, cutoff=None) -> DataFrame:
    """A relation from ``<folder>/<name>.csv``, its columns picked by name and cast; other columns aren't read."""
    schema, date_col = RELATIONS[name]
    path = os.path.join(folder, f"{name}.csv")
    try:
        raw = spark.read.csv(path, header=True, multiLine=False)
    except AnalysisException as e:
        raise FileNotFoundError(f"{name}: no input at {path}") from e
    fields = [f.strip().split(" ") for f in schema.split(",")]
    missing = [c for c, _ in fields if c not in raw.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    typed = raw.select(*(F.col(c).try_cast(t).alias(c) for c, t in fields))
    return as_of(typed, date_col, cutoff)


def read_relations(spark: SparkSession, folder: str, cutoff=None) -> dict[str, DataFrame]:
    return {name: read_relation(spark, folder, name, cutoff) for name in RELATIONS}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: on one machine, as in tests, a new folder of our own; on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid4()}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there: what follows has a short plan and survives lost executors."""
    path = fresh_folder(df.sparkSession, "stored")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


@contextmanager
def partitions_for(spark: SparkSession, rows: int, each: int = ROWS_A_PARTITION) -> Iterator[None]:
    """Inside, what is run shuffles to at least a partition for ``each`` rows, so that sorts stay in memory however large the input is."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), -(-rows // each)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_panel(panel: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by season, so that a season's readers touch its files only. Refuses to replace a result unless told to."""
    panel.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("season").parquet(path, compression="zstd")


def read_panel(spark: SparkSession, path: str, *seasons: int) -> DataFrame:
    panel = spark.read.parquet(path)
    return panel.where(F.col("season").isin(*seasons)) if seasons else panel


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV file with a header, for reports of a few rows."""
    report.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)
