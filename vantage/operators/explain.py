"""Why a prediction: additive contributions, top factors, importance, drivers, fact sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C


def linear_contributions(df: DataFrame, coefficients: dict[str, float | Column], means: dict[str, float | Column], intercept: float | Column, prefix: str = "shap_") -> DataFrame:
    """Columns shap_<feature> = coefficient x (value - mean) and ``base_value``: with it they sum to the linear prediction.

    For a linear model these are the exact Shapley values of independent features. A null value counts as the mean.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    parts = {f"{prefix}{f}": F.coalesce(lit(c) * (F.col(f).cast("double") - lit(means[f])), F.lit(0.0)) for f, c in coefficients.items()}
    base = reduce(lambda a, b: a + b, (lit(c) * lit(means[f]) for f, c in coefficients.items()), lit(intercept))
    return df.withColumns(parts | {"base_value": base})


def contributions(df: DataFrame, features: list[str], keep: list[str], prefix: str = "shap_") -> DataFrame:
    """Long form: keep, feature, shap, value (numbers) and text (strings)."""
    kinds = dict(df.dtypes)
    rows = F.array(*(
        F.struct(
            F.lit(f).alias("feature"), F.col(f"{prefix}{f}").alias("shap"), (F.lit(None).cast("double") if kinds[f] == "string" else F.col(f).cast("double")).alias("value"),
            (F.col(f) if kinds[f] == "string" else F.lit(None).cast("string")).alias("text"),
        ) for f in features
    ))
    return df.select(*keep, F.inline(rows))


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Contributions numbered by size within a key; equal ones by name."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("shap")), "feature")))


def top_factors(df: DataFrame, features: list[str], k: int = 5, prefix: str = "shap_") -> Column:
    """JSON list of the k largest contributions of a row: feature, label, value (3 places), shap (4), effect in % (1). No shuffle."""
    kinds = dict(df.dtypes)
    value = lambda f: F.col(f) if kinds[f] == "string" else F.round(F.col(f).cast("double"), 3).cast("string")
    items = F.array(*(
        F.struct(
            (-F.abs(F.col(f"{prefix}{f}"))).alias("size"), F.lit(f).alias("feature"), K.feature_label(F.lit(f)).alias("label"), value(f).alias("value"),
            F.round(F.col(f"{prefix}{f}"), 4).alias("shap"), F.round(F.expm1(F.col(f"{prefix}{f}")) * 100, 1).alias("effect_pct"),
        ) for f in features
    ))
    return F.to_json(F.transform(F.slice(F.array_sort(items), 1, k), lambda x: x.dropFields("size")))


def importance(long: DataFrame) -> DataFrame:
    """(feature, label, mean_abs_shap, mean_shap, share) of all features; shares sum to one."""
    t = long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("shap").alias("mean_shap"))
    return t.withColumn("share", F.col("mean_abs_shap") / F.sum("mean_abs_shap").over(Window.partitionBy(F.lit(0)))).withColumn("label", K.feature_label(F.col("feature")))  # a row a feature


def most_important(long: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` features of ``importance``, the largest first, ties by name."""
    return importance(long).orderBy(F.desc("mean_abs_shap"), "feature").limit(top)


def drivers(long: DataFrame, keys: list[str], context=C.CONTEXT) -> DataFrame:
    """Does context or performance carry a row's positive contributions? One side counts if it is at least twice the other."""
    up = F.greatest("shap", F.lit(0.0))
    t = long.groupBy(*keys).agg(F.sum(F.when(F.col("feature").isin(*context), up).otherwise(0.0)).alias("context"), F.sum(F.when(~F.col("feature").isin(*context), up).otherwise(0.0)).alias("performance"))
    kind = F.when((F.col("context") > 0) & (F.col("context") >= 2 * F.col("performance")), "context").when((F.col("performance") > 0) & (F.col("performance") >= 2 * F.col("context")), "performance")
    return t.withColumn("driver", kind.otherwise("mixed"))


def head_and_rest(long: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n largest contributions of a key, and all others as one."""
    rows = ranked(long, keys).select(*keys, F.when(F.col("nth") <= n, F.col("feature")).otherwise("all other").alias("feature"), "shap")
    return rows.groupBy(*keys, "feature").agg(F.sum("shap").alias("shap"))


def fact_sheet(lines: dict[str, Column]) -> Column:
    """Lines 'label: text'; those without text are left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), text) for label, text in lines.items()))
