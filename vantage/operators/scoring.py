"""Predicted against actual value: gaps, gaps against peers, strategies, and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C
from .select import medians
from .select import quantiles as exact_quantiles


def temporal_split(panel: DataFrame, season: str = "season", train_last: int = C.TRAIN_LAST) -> dict[str, DataFrame]:
    s = F.col(season)
    return {"train": panel.where(s <= train_last), "valid": panel.where(s == train_last + 1), "test": panel.where(s == train_last + 2), "live": panel.where(s == train_last + 3)}


def add_segments(df: DataFrame, age: str = "age", value: str = "target_value") -> DataFrame:
    return df.withColumns({"age_band": K.band(F.col(age), C.AGE_BANDS), "value_band": K.band(F.col(value), C.VALUE_BANDS)})


def score_frame(df: DataFrame, y_hat: str = "y_hat", y: str = "y", index: str = "market_index", peers: tuple[str, ...] = ("league", "age_band"), shrink: float = C.SHRINK) -> DataFrame:
    """Predicted value, log gap, and the gap less the peers' mean gap, which is shrunk towards 0 for few peers.

    A row whose peer group is unknown has no peer bias and no de-biased score.
    """
    gap = F.col(y_hat) - F.col(y)
    df = df.withColumns({"pred_value": K.to_value(F.col(y_hat), F.col(index)), "log_gap": gap, "score_raw": F.expm1(gap)})
    bias = df.groupBy(*peers).agg((F.sum("log_gap") / (F.count("log_gap") + F.lit(float(shrink)))).alias("cell_bias"))
    df = df.join(bias, list(peers), "left")  # a null peer equals none
    return df.withColumn("log_gap_debiased", F.col("log_gap") - F.col("cell_bias")).withColumn("score_debiased", F.expm1("log_gap_debiased"))


def strategies(df: DataFrame, linear_gap: str | None = None) -> DataFrame:
    """Strategy scores (null: never picked), outcome flags and the cell of age and value."""
    drop = -F.col("bt_last_update_log_change")
    has = F.col("outcome_log_change").isNotNull()
    extra = {"s_linear_raw": F.col(linear_gap)} if linear_gap else {}
    return df.withColumns({
        "s_model_raw": F.col("log_gap"), "s_model_debiased": F.col("log_gap_debiased"), "s_young_regulars": F.when(F.col("age") < C.YOUNG_MAX_AGE, F.col("minutes").cast("double")),
        "s_mean_reversion": F.when(drop > 0, drop), "s_all": F.lit(0.0), "has_outcome": has, "hit_raw": F.when(has, (F.col("outcome_log_change") > 0).cast("int")),
        "hit_rel": F.when(has, F.coalesce(F.col("outcome_rel_change") > 0, F.lit(False)).cast("int")),
        "cell": F.concat_ws(" | ", F.coalesce("age_band", F.lit("nan")), F.coalesce("value_band", F.lit("nan"))), **extra,
    })


def error_table(df: DataFrame, by: list[str], y: str = "y", y_hat: str = "y_hat", value: Column | None = None, value_hat: Column | None = None) -> DataFrame:
    """by, n, rmse, mae, r2, bias, mae and median error in money, median percent error. Sums in one grouped pass, exact medians by counting."""
    value, value_hat = F.col("target_value") if value is None else value, F.col("pred_value") if value_hat is None else value_hat
    rows = df.select(*by, F.col(y).alias("_y"), (F.col(y_hat) - F.col(y)).alias("_r"), F.abs(value_hat - value).alias("_off"))
    r, off = F.col("_r"), F.col("_off")
    sums = [
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"),
        (1 - F.sum(r * r) / F.nullif(F.count("_y") * F.var_pop("_y"), F.lit(0.0))).alias("r2"), F.avg(r).alias("bias"), F.avg(off).alias("mae_eur"),
    ]
    middle = medians(rows, by, {"medae_eur": off, "_middle": F.abs(r)})
    table = rows.groupBy(*by).agg(*sums).join(middle, by, "left") if by else rows.agg(*sums).crossJoin(F.broadcast(middle))  # one row
    return table.select(*by, "n", "rmse", "mae", "r2", "bias", "mae_eur", "medae_eur", F.expm1("_middle").alias("median_pct_error"))


def breakdown(df: DataFrame, dimensions: list[str], y: str = "y", y_hat: str = "y_hat", value: str = "target_value", value_hat: str = "pred_value") -> DataFrame:
    """Error metrics by segment of each dimension, in one grouped pass; null segments are left out."""
    pairs = F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dimensions)))
    return error_table(df.select("*", pairs).where("segment is not null"), ["dimension", "segment"], y, y_hat, F.col(value), F.col(value_hat))


def residual_quantiles(df: DataFrame, band: str, residual: Column, quantiles=C.INTERVAL_QUANTILES, overall: str = "overall") -> DataFrame:
    """(band, n, q10, q25, ...) for all rows and by band, linearly interpolated, exact and without a task that holds a band."""
    both = df.select(residual.alias("_r"), F.explode(F.array(F.lit(overall), F.col(band))).alias("band")).where("band is not null")
    return exact_quantiles(both, ["band"], "_r", {f"q{round(q * 100)}": q for q in quantiles})


def value_range(df: DataFrame, table: DataFrame, pred: str = "pred_value", bands=C.VALUE_BANDS, overall: str = "overall") -> DataFrame:
    """Middle 50 % and 80 % of values around a prediction, by its band; the overall quantiles where the band has none."""
    q = ["q10", "q25", "q75", "q90"]
    own = table.where(F.col("band") != overall).select(F.col("band").alias("_band"), *(F.col(x).alias(f"_{x}") for x in q))
    whole = table.where(F.col("band") == overall).select(*(F.col(x).alias(f"_all_{x}") for x in q))
    joined = df.withColumn("_band", K.band(F.col(pred), bands)).join(F.broadcast(own), "_band", "left").crossJoin(F.broadcast(whole))  # a row a band; one row
    at = lambda x: F.col(pred) * F.exp(F.coalesce(f"_{x}", f"_all_{x}"))
    out = joined.withColumns({"low_80": at("q10"), "low_50": at("q25"), "high_50": at("q75"), "high_80": at("q90")})
    return out.drop("_band", *(f"_{x}" for x in q), *(f"_all_{x}" for x in q))


def best_and_runner_up(table: DataFrame, model: str = "model", measure: str = "rmse") -> DataFrame:
    """(place, model, measure, gap): the best two rows by the smallest measure, ties by name, and how far each is from the best."""
    order = F.struct(F.col(measure).alias("m"), F.col(model).alias("model"))
    top = table.where(F.col(measure).isNotNull()).agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("top"))  # a row a model
    two = top.select(F.posexplode("top").alias("i", "t"), F.col("top")[0]["m"].alias("best"))
    return two.select((F.col("i") + 1).alias("place"), F.col("t.model").alias(model), F.col("t.m").alias(measure), (F.col("t.m") - F.col("best")).alias("gap"))
