"""Data quality: panel rules, point-in-time audits, differences of two builds, leakage proxies."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C


def count_failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_bad): how many rows each condition holds for, in one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()))
    return counts.unpivot([], list(rules), "rule", "n_bad")


def range_rules(ranges: dict[str, tuple]) -> dict[str, Column]:
    rules = {f"{c} below {lo}": F.col(c) < lo for c, (lo, _) in ranges.items() if lo is not None}
    return rules | {f"{c} above {hi}": F.col(c) > hi for c, (_, hi) in ranges.items() if hi is not None}


def point_in_time_rules(checks: dict[str, Column]) -> dict[str, Column]:
    """``checks``: name -> condition that must hold. Null, a missing source date, is no violation."""
    return {name: ~ok for name, ok in checks.items()}


PANEL_CHECKS = (
    "_max_app_date <= end_date", "_max_lineup_date <= end_date", "_max_transfer_date <= end_date", "_val_hist_date <= end_date",
    "_val_hist_date < target_date", "_index_asof_date <= end_date",
)


def validate_panel(
    panel: DataFrame, keys: list[str] | None = None, features: Iterable[str] | None = None, required: Iterable[str] = C.REQUIRED, ranges: dict[str, tuple] | None = None,
    checks: Iterable[str] = PANEL_CHECKS,
) -> DataFrame:
    """(rule, n_bad) of all panel rules. Missing columns are found from the schema and reported alone. ``checks`` are inequalities of dates that must hold."""
    keys, features, required = keys or ["player_id", "season"], list(features or C.feature_columns("ceiling")), list(required)
    spark = panel.sparkSession
    missing = [c for c in dict.fromkeys([*features, *required]) if c not in panel.columns]
    if missing:
        return spark.createDataFrame([(f"missing column {c}", 1) for c in missing], "rule string, n_bad bigint")
    kinds = dict(panel.dtypes)
    numeric = [c for c in features if kinds[c] != "string"]
    rules = {f"{c} is null": F.col(c).isNull() for c in required} | range_rules(C.RANGES if ranges is None else ranges)
    rules["minutes exceed 130 per appearance"] = F.col("minutes") > F.col("apps") * C.MAX_MINUTES_PER_GAME
    rules["infinite feature value"] = reduce(lambda a, b: a | b, (F.coalesce(F.abs(F.col(c).cast("double")) == float("inf"), F.lit(False)) for c in numeric))
    expected = F.ln("target_value") - F.col("market_index")
    rules["y != ln(target_value) - market_index"] = F.abs(F.col("y") - expected) > 1e-8 + 1e-5 * F.abs(expected)
    rules |= point_in_time_rules({name: F.expr(name) for name in checks})
    rules["target outside the season-end window"] = F.abs(F.datediff("target_date", "end_date")) > C.TARGET_WINDOW_DAYS
    repeated = panel.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_bad")).select(F.lit("repeated key").alias("rule"), "n_bad")
    empty = panel.limit(1).agg((F.count(F.lit(1)) == 0).cast("bigint").alias("n_bad")).select(F.lit("panel is empty").alias("rule"), "n_bad")
    return count_failures(panel, rules).unionByName(repeated).unionByName(empty)


def assert_valid(panel: DataFrame) -> None:
    bad = validate_panel(panel).where("n_bad > 0").collect()
    if bad:
        raise ValueError("the panel breaks " + "; ".join(f"{r.rule} ({r.n_bad})" for r in bad))


def panel_diff(a: DataFrame, b: DataFrame, keys: list[str], features: Iterable[str], rtol: float = 1e-9) -> DataFrame:
    """(feature, n_diff) over keys in both; null equals null, numbers may differ by a relative 1e-9."""
    features = list(features)
    joined = a.select(*keys, *(F.col(f).alias(f"_a_{f}") for f in features)).join(b.select(*keys, *(F.col(f).alias(f"_b_{f}") for f in features)), keys)

    def differs(f: str) -> Column:
        x, y = F.col(f"_a_{f}"), F.col(f"_b_{f}")
        if dict(a.dtypes)[f] in ("double", "float"):
            near = F.abs(x - y) <= rtol * F.greatest(F.abs(x), F.abs(y), F.lit(1e-300))
            return ~F.coalesce(near, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    return joined.agg(*(F.count_if(differs(f)).alias(f) for f in features)).unpivot([], features, "feature", "n_diff")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).join(b.select(*keys), keys, "left_anti")


def feature_correlations(df: DataFrame, features: list[str], target: str = "y") -> DataFrame:
    """(feature, corr): Pearson's correlation of each numeric feature with the target, in one pass."""
    return df.agg(*(F.corr(F.col(f).cast("double"), F.col(target)).alias(f) for f in features)).unpivot([], features, "feature", "corr")
