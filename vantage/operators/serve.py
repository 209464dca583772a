"""Queries over scored rows: filters, ranked lists, search, profiles, explanations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C
from .explain import ranked
from .scoring import value_range


def conjunction(conditions: Iterable[Column | None]) -> Column:
    """All conditions that are given; none: true."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def undervalued(
    df: DataFrame, score: str = "score_debiased", value: str = "target_value", key: str = "player_id", position_group: str | None = None, position: str | None = None,
    league: str | None = None, min_age: float | None = None, max_age: float | None = None, min_value: float | None = C.VALUE_FLOOR, limit: int = 50,
) -> DataFrame:
    """The best rows by score that meet the filters, ranked from 1. A floor of 0 or none is no floor."""
    same = lambda c, v: F.col(c) == v if v is not None else None
    keep = conjunction([
        same("position_group", position_group), same("position", position), same("league", league), F.col("age") >= min_age if min_age is not None else None,
        F.col("age") <= max_age if max_age is not None else None, F.col(value) >= min_value if min_value else None, F.col(score).isNotNull(),
    ])
    order = [F.desc(score), F.col(key)]
    best = df.where(keep).orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # over `limit` rows


def search(df: DataFrame, text: str, columns: list[str], by: str, key: str, limit: int = 20) -> DataFrame:
    """Rows with the text in a column, in any case and taken literally, the largest values first."""
    return df.where(K.shared_contains(text, *map(F.col, columns))).orderBy(F.desc_nulls_last(by), key).limit(limit)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; raises if there is none."""
    found = df.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise KeyError(f"no {key} {value!r}")
    return found


def filter_options(df: DataFrame, categories: list[str], ranges: list[str]) -> DataFrame:
    """(option, value): the distinct values of categories, and least and greatest of ranges."""
    values = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in categories)))).where("value is not null").distinct()
    ends = df.agg(*(f(c).cast("string").alias(f"{c}_{n}") for c in ranges for n, f in (("min", F.min), ("max", F.max))))
    return values.unionByName(ends.unpivot([], ends.columns, "option", "value"))


def explanation(long: DataFrame, keys: list[str], index: Column) -> DataFrame:
    """A key's contributions, largest first, with label, plain value and effect in percent."""
    return ranked(long, keys).select(
        *keys, "nth", "feature", K.feature_label(F.col("feature")).alias("label"), K.display_value(F.col("feature"), F.col("value"), index, F.col("text")).alias("shown"),
        "shap", (F.expm1("shap") * 100).alias("effect_pct"),
    )


def league_names(df: DataFrame, code: str = "league", stored: str = "league_name") -> DataFrame:
    return df.withColumn(stored, F.coalesce(F.try_element_at(K.literal_map(C.LEAGUE_NAMES), F.col(code)), F.col(stored)))


def record(df: DataFrame) -> DataFrame:
    """Rows safe to hand out: NaN as null, dates as ISO text."""
    kinds = dict(df.dtypes)
    safe = {c: K.nan_to_null(F.col(c)) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd") if t == "date" else F.col(c) for c, t in kinds.items()}
    return df.select(*(safe[c].alias(c) for c in df.columns))


def leaderboard(df: DataFrame) -> DataFrame:
    return df.select("rank", "name", F.round("age", 1).alias("age"), F.round(F.col("target_value") / 1e6, 2).alias("value_m"), F.round(F.col("pred_value") / 1e6, 2).alias("pred_m"), F.round(F.col("score_debiased") * 100, 1).alias("score_pct"))


def with_missing(rows: DataFrame, features: list[str], allowed: Iterable[str]) -> DataFrame:
    """Feature rows for prediction: unknown columns are refused, absent ones are null."""
    unknown = [c for c in rows.columns if c not in {*features, *allowed}]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    return rows.withColumns({f: F.lit(None).cast("string" if f in C.CATEGORICAL else "double") for f in features if f not in rows.columns})


def reliability(metrics: DataFrame, results: DataFrame, strategy: str = "model_debiased", k: str = "top_decile") -> DataFrame:
    """One row of what a report may say about the model: its typical error in per cent, the picks' hit rate and the base rate."""
    rate = lambda s, size: F.max(F.when((F.col("strategy") == s) & (F.col("k") == size), F.col("hit_raw")))
    rates = results.agg(rate(strategy, k).alias("hit_rate"), rate("all", "all").alias("base_rate"))
    return metrics.select((F.col("median_pct_error") * 100).alias("typical_error_pct")).crossJoin(F.broadcast(rates))  # one row each


def summary(reports: dict[str, DataFrame]) -> DataFrame:
    """(report, record): the rows of several reports as JSON records, told apart by name."""
    parts = [df.select(F.lit(name).alias("report"), F.to_json(F.struct(*df.columns)).alias("record")) for name, df in reports.items()]
    return reduce(DataFrame.unionByName, parts)


def panel_summary(panel: DataFrame, by: str = "season", value: str = "target_value", index: str = "market_index") -> DataFrame:
    """Rows, median value and market index of each season."""
    return panel.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.percentile(value, F.lit(0.5)).alias("median_value"), F.max(index).alias("market_index"))


def listing(df: DataFrame, columns: list[str], by: str, key: str) -> DataFrame:
    """All rows with the given columns, the largest ``by`` first."""
    return df.select(*columns).orderBy(F.desc_nulls_last(by), key)


def scalars(df: DataFrame, columns: list[str]) -> DataFrame:
    """The one row of values that all rows share; more than one means that they don't share them."""
    return df.select(*columns).distinct()


def rounded(df: DataFrame, keep: list[str], measures: list[str], places: int = 3) -> DataFrame:
    return df.select(*keep, *(F.round(m, places).alias(m) for m in measures))


def robustness(results: DataFrame, k: str = "top_decile") -> DataFrame:
    """Each strategy's rates at one size, over known outcomes and with missing ones as failures."""
    both = [c for m in ("hit_raw", "lift_raw", "matched_lift_raw") for c in (m, f"{m}_missing_as_fail")]
    return results.where(F.col("k") == k).select("strategy", "n_flagged", "missing_rate", *both)


def accuracy(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """(model, players, typical_error, explained, median_error_pct) for readers: plain names, few places. Models without a name are left out."""
    shown = F.try_element_at(K.literal_map(names), F.col("model"))
    return metrics.select(
        shown.alias("model"), F.col("n").alias("players"), F.round("rmse", 3).alias("typical_error"), F.round("r2", 3).alias("explained"), F.round(F.col("median_pct_error") * 100, 1).alias("median_error_pct")
    ).where("model is not null")


def profile(df: DataFrame, key: str, value, columns: list[str], stats: list[str], quantiles: DataFrame, pred: str = "pred_value") -> DataFrame:
    """One key's columns, its ``stats`` as a struct, and the ``range`` of values around its prediction. Raises if there is none."""
    one = value_range(lookup(df, key, value), quantiles, pred)
    return one.select(key, *columns, F.struct(*stats).alias("stats"), F.struct(pred, "low_80", "low_50", "high_50", "high_80").alias("range"))
