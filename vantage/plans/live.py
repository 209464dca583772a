"""Jobs on a finished panel: a season's backtest, the test season (once), live scores with their reasons, intervals."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..operators import backtest as B
from ..operators import explain as X
from ..operators import learners as L
from ..operators import scoring as S
from ..operators.stages import save_model
from ..sources.relations import stored, write_report

ALL_STRATEGIES = ["all", "model_raw", "model_debiased", "linear_raw", "young_regulars", "mean_reversion"]
ALL_SIZES: dict[str, int | None] = {"top_decile": None, "top_100": 100, "top_50": 50}
SCORES = ["y_hat", "pred_value", "log_gap", "score_raw", "cell_bias", "log_gap_debiased", "score_debiased"]


def season_scores(panel: DataFrame, season: int, features: list[str], params: dict | None = None) -> DataFrame:
    """A season's rows with the scores of all six strategies, outcome flags and cells. Models see earlier seasons only."""
    train, rows = panel.where(F.col("season") < season), panel.where(F.col("season") == season)
    trees, fitted, _ = L.fit_and_score("boosted", train, rows, features, params)
    ridge, _, _ = L.fit_and_score("linear", train, rows, features)
    both = L.predict(ridge, fitted, "linear_hat").withColumn("linear_gap", F.col("linear_hat") - F.col("y"))
    return stored(S.strategies(S.score_frame(S.add_segments(both)), linear_gap="linear_gap"))


def run_season(scores: DataFrame, key: str, floors: list[float] | None = None) -> dict[str, DataFrame]:
    """Reports of one scored season: strategies by size and floor, missing outcomes, rank correlations."""
    named = [n for n in ALL_STRATEGIES if n != "all"]
    return {
        "strategies": B.evaluate(B.universes(scores, floors or [0.0]), ALL_STRATEGIES, ALL_SIZES, ["season", "floor"], key),
        "missing": B.missingness(scores, named, ["season"], key),
        "ranks": B.rank_correlation(scores, ["model_raw", "model_debiased", "linear_raw", "mean_reversion"], ["outcome_log_change", "outcome_rel_change"], ["season"], key),
    }


def run_seasons(panel: DataFrame, seasons: list[int], features: list[str], key: str, params: dict | None = None) -> dict[str, DataFrame]:
    """``run_season`` of several seasons, each with models of its own past."""
    scored = L.beside([partial(season_scores, panel, s, features, params) for s in seasons])
    runs = [run_season(scores, key) for scores in scored]
    return {name: reduce(DataFrame.unionByName, (r[name] for r in runs)) for name in runs[0]}


def _exists(spark, path: str) -> bool:
    try:
        return bool(spark.read.csv(path).columns) or True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def run_test(panel: DataFrame, season: int, candidates: dict[str, tuple[str, list[str], dict | None]], path: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Metrics of the candidates (label -> model, features, parameters) on the test season, and their breakdowns by segment.

    All seasons before it train. A report at ``path`` means that the season was looked at: it isn't again unless forced, so
    that it doesn't become a season to tune on.
    """
    if path and not force and _exists(panel.sparkSession, path):
        raise FileExistsError(f"the test season was evaluated before ({path}); evaluating it again would make it a tuning season")
    train, rows = panel.where(F.col("season") < season), panel.where(F.col("season") == season)

    def one(label: str, name: str, features: list[str], params: dict | None) -> tuple[DataFrame, DataFrame]:
        scored = L.fit_and_score(name, held, rows, features, params)[1].withColumn("pred_value", F.exp(F.col("y_hat") + F.col("market_index")))
        scored = stored(S.add_segments(scored))
        parts = S.breakdown(scored, ["position_group", "league", "age_band", "value_band"])
        return L.metrics_of(scored).select(F.lit(label).alias("model"), "*"), parts.select(F.lit(label).alias("model"), "*")

    held = train.persist()
    metrics, parts = zip(*L.beside([partial(one, label, *what) for label, what in candidates.items()]), strict=True)
    held.unpersist()
    report, by_segment = reduce(DataFrame.unionByName, metrics), reduce(DataFrame.unionByName, parts)
    if path:
        report = stored(report)
        write_report(report, path, overwrite=force)
    return report, by_segment


def run_live(panel: DataFrame, season: int, features: list[str], key: str, display: list[str], params: dict | None = None, folder: str | None = None, k: int = 5, model=None) -> DataFrame:
    """The live season's table: ``display``, features, scores, top factors as JSON, and a contribution shap_<feature> of each feature.

    Trees are fitted on all seasons before it, unless a fitted ``model`` is given. Contributions must add up to the prediction, or the job fails. With a
    ``folder``, the model, the table and the overall importance are written there, for ``load_model`` and readers.
    """
    train, rows = panel.where(F.col("season") < season), panel.where(F.col("season") == season)
    model = L.fit_and_score("boosted", train, rows, features, params)[0] if model is None else model
    scored = L.predict(model, rows)
    shap = stored(L.explain_trees(model, rows, features, [key, "season"]))
    total = reduce(lambda a, b: a + b, (F.col(f"shap_{f}") for f in features), F.col("base_value"))
    off = shap.agg(F.max(F.abs(total - F.col("y_hat")))).first()[0] or 0.0
    if off > 1e-6:
        raise ArithmeticError(f"contributions differ from predictions by up to {off}")
    joined = S.score_frame(S.add_segments(scored)).join(shap.drop("y_hat"), [key, "season"])
    shown = list(dict.fromkeys([key, "season", *display, *features]))
    contributions = [f"shap_{f}" for f in features]
    table = joined.select(*shown, *SCORES, X.top_factors(joined, features, k).alias("top_factors"), *contributions, "base_value")
    if folder:
        save_model(model, f"{folder}/model")
        table.write.parquet(f"{folder}/table", compression="zstd")
        write_report(X.importance(X.contributions(joined, features, [key])).orderBy(F.desc("mean_abs_shap"), "feature"), f"{folder}/importance")
        table = panel.sparkSession.read.parquet(f"{folder}/table")
    return table


def run_intervals(panel: DataFrame, season: int, features: list[str], params: dict | None = None, model=None) -> DataFrame:
    """Residual quantiles of the test season's model (or of the fitted ``model``), for all rows and by the band of the predicted value."""
    train, rows = panel.where(F.col("season") < season), panel.where(F.col("season") == season)
    model = L.fit_and_score("boosted", train, rows, features, params)[0] if model is None else model
    scored = L.predict(model, rows)
    predicted = F.exp(F.col("y_hat") + F.col("market_index"))
    banded = S.add_segments(scored.withColumn("_pred", predicted).select("age", "_pred", "y", "y_hat"), value="_pred")
    banded = stored(banded.select("value_band", "y", "y_hat"))  # quantiles are found in several rounds: none predicts anew
    return S.residual_quantiles(banded, "value_band", F.col("y") - F.col("y_hat"), C.INTERVAL_QUANTILES)


def decide(panel: DataFrame, season: int, features: list[str], group: list[str], key: str, model: str = "boosted", params: dict | None = None, n_boot: int = 2000) -> DataFrame:
    """One row: RMSE with less RMSE without a group of features, its 95 % interval, and whether to keep the group."""
    from ..operators.resample import bootstrap_rmse_difference

    train, rows = panel.where(F.col("season") < season), panel.where(F.col("season") == season)
    _, fitted, _ = L.fit_and_score(model, train, rows, features, params)
    without, _, _ = L.fit_and_score(model, train, rows, [f for f in features if f not in group], params)
    both = L.predict(without, fitted.withColumnRenamed("y_hat", "with_hat"), "without_hat")
    gap = bootstrap_rmse_difference(stored(both), "y", "with_hat", "without_hat", key, n_boot)
    return gap.withColumn("keep", B.keep_feature(F.col("diff"), F.col("diff_ci_low"), F.col("diff_ci_high")))
