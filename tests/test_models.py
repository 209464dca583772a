"""Saved pipelines, the hold-out search against a loop, importances against plain Python, and the jobs on a panel."""

import json
import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vantage.operators import learners, stages
from vantage.plans import live

FEATURES = ["minutes", "age", "league"]


@pytest.fixture(scope="module")
def panel(spark):
    """Four seasons; values follow minutes and league, outcomes partly what a model can see."""
    draw, rows = random.Random(3), []
    for season in range(2020, 2024):
        for i in range(90):
            minutes, league = draw.choice([None, *range(400, 3000, 50)]), draw.choice(["a", "a", "b", "b", None, "rare" if i == 7 else "a"])
            y = (minutes or 900) / 1000 + (league == "b") + draw.gauss(0, 0.2)
            later = draw.choice([None, 0.1, -0.1, 0.3]) if season < 2023 else None
            rows.append((i, season, f"n{i}", minutes, draw.uniform(17, 34), league, draw.choice(["x", "y"]), y, 13.0, math.exp(y + 13), later, later, draw.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "player_id long, season int, name string, minutes int, age double, league string, position_group string, y double, market_index double, target_value double, outcome_log_change double, outcome_rel_change double, bt_last_update_log_change double").cache()


@pytest.mark.parametrize("name", ["linear", "boosted"])
def test_a_saved_model_predicts_raw_rows(panel, tmp_path, name):
    train, rows = panel.where("season < 2022"), panel.where("season = 2022")
    model, scored, _ = learners.fit_and_score(name, train, rows, FEATURES, {"maxIter": 3})
    stages.save_model(model, str(tmp_path / "model"))
    loaded = stages.load_model(str(tmp_path / "model"))
    raw = rows.select("player_id", *FEATURES).unionByName(rows.limit(1).select(F.lit(999).alias("player_id"), F.lit(None).cast("int").alias("minutes"), "age", F.lit("never seen").alias("league")))
    want = {r.player_id: r.y_hat for r in scored.collect()}
    got = {r.player_id: r.y_hat for r in learners.predict(loaded, raw).collect()}
    assert {k: v for k, v in got.items() if k != 999} == want and math.isfinite(got[999])
    with pytest.raises(Exception, match="(?i)exist|overwrite"):
        stages.save_model(model, str(tmp_path / "model"))
    stages.save_model(model, str(tmp_path / "model"), overwrite=True)


def test_levels_are_frozen(spark):
    train = spark.createDataFrame([("a", "p")] * 3 + [("b", "q")] * 3 + [("rare", "q"), (None, None)], "c string, d string")
    model = stages.LevelFreezer(inputCols=["c", "d"], least=3).fit(train)
    seen = spark.createDataFrame([("a", "p"), ("rare", "new"), ("new", "q"), (None, None)], "c string, d string")
    assert [tuple(r) for r in model.transform(seen).collect()] == [("a", "p"), ("other", None), ("other", "q"), (None, None)]
    none = stages.LevelFreezer(inputCols=["c"], least=3).fit(train.limit(0))
    assert [r.c for r in none.transform(seen).collect()] == [None] * 4
    assert stages.LevelFreezer(inputCols=[]).fit(train).transform(seen).columns == ["c", "d"]


def test_search_equals_a_loop(panel):
    train, valid = panel.where("season < 2022"), panel.where("season = 2022")
    whole = {"subsamplingRate": 1.0}  # a sample would depend on how rows are dealt to tasks
    candidates = [{"maxDepth": 2, "maxIter": 4} | whole, {"maxDepth": 3, "maxIter": 6, "stepSize": 0.3} | whole, {"maxIter": 2, "maxDepth": 1} | whole]
    table = learners.search_params(train, valid, FEATURES, candidates, rungs=[0.5, 1.0]).collect()
    numeric, categorical = learners.split_columns(train, FEATURES)
    ready, inputs, coded = learners.preparation(numeric, categorical)
    prepared = Pipeline(stages=[*ready, VectorAssembler(inputCols=inputs + coded, outputCol="features")]).fit(train)
    for r in (r for r in table if r.trial):
        params = json.loads(r.params)
        model = learners.boosted(**params | {"maxIter": r.rounds}).fit(prepared.transform(train))
        alone = model.transform(prepared.transform(valid)).agg(F.sqrt(F.avg((F.col("y_hat") - F.col("y")) ** 2))).first()[0]
        assert r.rmse == pytest.approx(alone, abs=1e-9), r
    first, last = [r for r in table if r.turn == 0], [r for r in table if r.turn == 1]
    assert {r.trial for r in first} == {0, 1, 2, 3} and {r.trial for r in last} == {r.trial for r in sorted(first, key=lambda r: (r.rmse, r.trial))[:2]}
    best = [r for r in table if r.best]
    assert len(best) == 1 and best[0].rmse == min(r.rmse for r in last) and json.loads(first[0].params) == {}
    assert learners.rungs_of(1) == [1.0] and learners.rungs_of(2) == [0.5, 1.0] and learners.rungs_of(16) == [0.25, 0.5, 1.0]


def test_importances(panel):
    """Permutation by a plain loop over the same deals; a feature that no split uses has no gain."""
    from vantage.operators.trees import total_gain

    train, rows = panel.where("season < 2022 and minutes is not null"), panel.where("season = 2022 and minutes is not null")
    model, _, _ = learners.fit_and_score("linear", train, rows, ["minutes", "age"])
    got = {r.feature: r.importance for r in learners.permutation_importance(model, rows, ["minutes", "age"], "player_id", repeats=2).collect()}
    ids = rows.select("player_id", "minutes", "age", "y", *(F.xxhash64(F.lit(learners.SEED + r), F.col("player_id")).alias(f"h{r}") for r in range(2))).orderBy("player_id").collect()
    rmse = lambda data: math.sqrt(sum((p.y_hat - p.y) ** 2 for p in learners.predict(model, rows.sparkSession.createDataFrame(data, "minutes int, age double, y double")).collect()) / len(data))
    base = rmse([(r.minutes, r.age, r.y) for r in ids])
    for f in ("minutes", "age"):
        rises = []
        for d in range(2):
            donors = sorted(ids, key=lambda r: (r[f"h{d}"], r.player_id))
            rises.append(rmse([(x.minutes if f == "minutes" else r.minutes, x.age if f == "age" else r.age, r.y) for r, x in zip(ids, donors, strict=True)]) - base)
        assert got[f] == pytest.approx(sum(rises) / 2, abs=1e-9)
    trees, _, _ = learners.fit_and_score("boosted", train, rows, FEATURES, {"maxIter": 3})
    gain = {r.feature: r for r in learners.gain_importance(trees, train).collect()}
    assert set(gain) == set(FEATURES) and sum(r.share for r in gain.values()) == pytest.approx(1) and sum(r.gain for r in gain.values()) == pytest.approx(sum(total_gain(trees.stages[-1]).values()))


def test_season_reports(panel):
    scores = live.season_scores(panel, 2022, FEATURES, {"maxIter": 3})
    assert scores.count() == 90 and {r.season for r in scores.select("season").distinct().collect()} == {2022}
    assert {f"s_{n}" for n in live.ALL_STRATEGIES} <= set(scores.columns)
    reports = live.run_season(scores, "player_id")
    sizes = {(r.strategy, r.k) for r in reports["strategies"].collect()}
    assert {("all", "all"), ("linear_raw", "top_decile"), ("model_debiased", "top_50")} <= sizes
    assert {r.strategy for r in reports["missing"].collect()} == set(live.ALL_STRATEGIES) - {"all"}
    assert {r.strategy for r in reports["ranks"].collect()} == {"model_raw", "model_debiased", "linear_raw", "mean_reversion"}


def test_live_job(spark, panel, tmp_path):
    table = live.run_live(panel, 2023, FEATURES, "player_id", ["name", "target_value"], {"maxIter": 3}, str(tmp_path / "live"))
    rows = table.collect()
    assert len(rows) == 90 and all(r.y_hat == pytest.approx(r.base_value + sum(r[f"shap_{f}"] for f in FEATURES), abs=1e-6) for r in rows)
    assert all(len(json.loads(r.top_factors)) == 3 for r in rows) and {"name", "score_debiased", "cell_bias"} <= set(table.columns)
    model = stages.load_model(str(tmp_path / "live" / "model"))
    again = {r.player_id: r.y_hat for r in learners.predict(model, panel.where("season = 2023")).collect()}
    assert all(again[r.player_id] == pytest.approx(r.y_hat) for r in rows)
    importance = spark.read.csv(str(tmp_path / "live" / "importance"), header=True, inferSchema=True).collect()
    assert [r.feature for r in importance] == [r.feature for r in sorted(importance, key=lambda r: -r.mean_abs_shap)] and len(importance) == 3


def test_the_test_season_is_looked_at_once(panel, tmp_path):
    candidates = {"ridge": ("linear", FEATURES, None), "mean": ("mean", FEATURES, None)}
    path = str(tmp_path / "test")
    report, parts = live.run_test(panel, 2022, candidates, path)
    rmse = {r.model: r.rmse for r in report.collect()}
    assert rmse["ridge"] < rmse["mean"] and {r.dimension for r in parts.collect()} == {"position_group", "league", "age_band", "value_band"}
    with pytest.raises(FileExistsError, match="evaluated before"):
        live.run_test(panel, 2022, candidates, path)
    assert live.run_test(panel, 2022, candidates, path, force=True)[0].count() == 2


def test_intervals_and_decision(panel):
    bands = live.run_intervals(panel, 2022, FEATURES, {"maxIter": 3}).collect()
    whole = next(r for r in bands if r.band == "overall")
    assert whole.n == 90 and whole.q10 <= whole.q25 <= whole.q75 <= whole.q90 and sum(r.n for r in bands) == 180
    needed = live.decide(panel, 2022, FEATURES, ["minutes"], "player_id", "linear", n_boot=100).first()
    idle = live.decide(panel, 2022, FEATURES, ["age"], "player_id", "linear", n_boot=100).first()
    assert needed.diff < -0.1 and needed.keep and not idle.keep
