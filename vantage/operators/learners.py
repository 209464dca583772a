"""Regressors on the panel: baselines, ridge, forest and boosted trees as pyspark.ml pipelines, comparison and importance."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..sources.relations import stored
from .ordered import positions
from .scoring import error_table
from .stages import LevelFreezer, Prepared
from .trees import feature_of, named_gain, tree_contributions

SEED = 42
TREES_A_FIT = 25  # of a forest


def split_columns(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    kinds = dict(df.dtypes)
    return [f for f in features if kinds[f] != "string"], [f for f in features if kinds[f] == "string"]


def freeze_levels(train: DataFrame, df: DataFrame, columns: list[str], least: int = C.MIN_LEVEL_COUNT) -> DataFrame:
    """``df`` with the levels that ``train`` has often; see ``FrozenLevels``."""
    return LevelFreezer(inputCols=columns, least=least).fit(train).transform(df)


def mean_baseline(train: DataFrame, df: DataFrame, y: str = "y") -> DataFrame:
    return df.crossJoin(F.broadcast(train.agg(F.avg(y).alias("y_hat"))))  # one row


def last_value_baseline(train: DataFrame, df: DataFrame, y: str = "y", last: str = "val_last_rel") -> DataFrame:
    return df.crossJoin(F.broadcast(train.agg(F.avg(y).alias("_mean")))).withColumn("y_hat", F.coalesce(last, "_mean")).drop("_mean")  # one row


def preparation(numeric: list[str], categorical: list[str]) -> tuple[list, list[str], list[str]]:
    """Stages from raw rows to numbers: frozen levels, missing flags, medians, level numbers; the columns of numbers and of level numbers."""
    filled, coded = [f"{c}_filled" for c in numeric], [f"{c}_index" for c in categorical]
    stages: list = [LevelFreezer(inputCols=categorical)] if categorical else []
    stages.append(Prepared(numeric=numeric, categorical=categorical))
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=filled))
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=coded, handleInvalid="keep"))
    return stages, filled + [f"{c}_missing" for c in numeric], coded


def build(name: str, numeric: list[str], categorical: list[str], params: dict | None = None, y: str = "y", ridge: float = 1.0, rows: int = 1000) -> Pipeline:
    """A pipeline from raw rows to y_hat for ``linear``, ``forest`` or ``boosted``. ``params`` go to the trees; ``rows`` scales the ridge penalty.

    Fitted, it can be saved, and a loaded one predicts raw rows: levels, medians and flags are stages of it.
    """
    if name not in ("linear", "forest", "boosted"):
        raise ValueError(f"no model is called {name!r}")
    stages, inputs, coded = preparation(numeric, categorical)
    if name == "linear":
        if coded:
            stages.append(OneHotEncoder(inputCols=coded, outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep"))
        stages += [
            VectorAssembler(inputCols=inputs + [f"{c}_hot" for c in categorical], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            LinearRegression(labelCol=y, predictionCol="y_hat", regParam=ridge / rows, elasticNetParam=0.0, standardization=False),
        ]
        return Pipeline(stages=stages)
    stages.append(VectorAssembler(inputCols=inputs + coded, outputCol="features"))
    return Pipeline(stages=stages + (forest((params or {}).get("numTrees", 400), y) if name == "forest" else [boosted(y, **(params or {}))]))


def forest(trees: int, y: str = "y", at_once: int = TREES_A_FIT) -> list:
    """Stages of a forest: parts of at most ``at_once`` trees, each with a seed of its own, and the mean over all trees.

    A fit holds for each row how often every tree drew it and the node it has come to: four bytes each a row and tree, which
    for all trees at once would leave memory. Held nodes spare the walk from the root at each level; the trees are the same.
    """
    sizes = [min(at_once, trees - i) for i in range(0, trees, at_once)]
    names = [f"y_hat_{i}" for i in range(len(sizes))] if len(sizes) > 1 else ["y_hat"]
    common = {"labelCol": y, "maxBins": 128, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.33", "maxDepth": 10, "cacheNodeIds": True}
    parts: list = [RandomForestRegressor(numTrees=n, predictionCol=name, seed=SEED + i, **common) for i, (n, name) in enumerate(zip(sizes, names, strict=True))]
    if len(parts) > 1:
        total = " + ".join(f"{n} * {name}" for n, name in zip(sizes, names, strict=True))
        parts.append(SQLTransformer(statement=f"SELECT *, ({total}) / {trees} AS y_hat FROM __THIS__"))
    return parts


def trees_of(model: PipelineModel) -> list:
    """The pipeline's fitted trees: one model, or the parts of a forest."""
    return [s for s in model.stages if hasattr(s, "trees")]


def boosted(y: str = "y", **params) -> GBTRegressor:
    return GBTRegressor(**{"labelCol": y, "predictionCol": "y_hat", "seed": SEED, "maxBins": 128, "maxIter": 60, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8} | params)


def fit_and_score(name: str, train: DataFrame, valid: DataFrame, features: list[str], params: dict | None = None, y: str = "y") -> tuple[PipelineModel | None, DataFrame, float]:
    """Fitted model, scored rows, seconds. Levels, medians and level numbers are those of ``train``."""
    began = time.time()
    if name == "mean":
        return None, mean_baseline(train, valid, y), time.time() - began
    if name == "last_value":
        return None, last_value_baseline(train, valid, y), time.time() - began
    own = not train.is_cached
    rows = train.persist() if own else train
    model = build(name, *split_columns(train, features), params, y, rows=max(rows.count(), 1)).fit(rows)
    if own:
        rows.unpersist()
    return model, predict(model, valid), time.time() - began


def predict(model: PipelineModel, df: DataFrame, name: str = "y_hat") -> DataFrame:
    """``df`` as it came, with the prediction: what the stages make of its columns stays inside."""
    own = df.withColumn("_raw", F.struct(*df.columns)).drop("y_hat", "features", "raw")  # names that stages give
    return model.transform(own).select("_raw.*", F.col("y_hat").alias(name))


def explain_trees(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str], prefix: str = "shap_") -> DataFrame:
    """``keep``, y_hat, shap_<feature> and base_value: exact contributions of the pipeline's trees, added up over a feature's columns."""
    ready, at, places = model.transform(df), 0, {f: [] for f in features}
    for column, width in vector_widths(model, df).items():
        places[feature_of(column)] += range(at, at + width)
        at += width
    parts = tree_contributions(trees_of(model), ready.select(*keep, "y_hat", "features"), "features", at, [*keep, "y_hat"])
    added = [reduce(lambda a, b: a + b, (F.col(f"c{i}") for i in own), F.lit(0.0)).alias(f"{prefix}{f}") for f, own in places.items()]
    return parts.select(*keep, "y_hat", *added, "base_value")


def metrics_of(scored: DataFrame, y: str = "y", index: str = "market_index", value: str = "target_value") -> DataFrame:
    """Error metrics of predictions, which are stored first: medians are found in several rounds, and none of them predicts anew."""
    scored = stored(scored.select(*dict.fromkeys([y, "y_hat", index, value])))
    return error_table(scored, [], y, "y_hat", F.col(value), F.exp(F.col("y_hat") + F.col(index)))


def beside(jobs: list[Callable], at_once: int = 4) -> list:
    """What the jobs return, in their order; ``at_once`` of them run beside each other, since one fit rarely keeps all cores busy."""
    with ThreadPool(min(at_once, max(len(jobs), 1))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def compare(train: DataFrame, valid: DataFrame, feature_sets: dict[str, list[str]], models: dict[str, list[str]], params: dict | None = None) -> DataFrame:
    """(kind, model, metrics, seconds) of each feature set's models, fitted beside each other on training rows that are held once."""

    def one(kind: str, name: str) -> DataFrame:
        _, scored, seconds = fit_and_score(name, rows, valid, feature_sets[kind], (params or {}).get(name))
        return metrics_of(scored).select(F.lit(kind).alias("kind"), F.lit(name).alias("model"), "*", F.lit(round(seconds, 3)).alias("fit_seconds"))

    rows = train.repartition(train.sparkSession.sparkContext.defaultParallelism).persist()  # even shares: every level of every tree waits for the largest, and each sends its counts
    out = beside([partial(one, kind, name) for kind, names in models.items() for name in names])
    rows.unpersist()
    return reduce(DataFrame.unionByName, out)


def ablate(train: DataFrame, valid: DataFrame, features: list[str], groups: dict[str, list[str]], model: str = "linear") -> DataFrame:
    """(variant, metrics): all features, and without each group."""
    variants = {"all": features} | {f"without {g}": [f for f in features if f not in gone] for g, gone in groups.items()}
    out = [metrics_of(fit_and_score(model, train, valid, fs)[1]).select(F.lit(v).alias("variant"), "*") for v, fs in variants.items()]
    return reduce(DataFrame.unionByName, out)


def param_maps(estimator, candidates: list[dict]) -> list[dict]:
    """Candidates (parameter name -> value) as the maps that ``fitMultiple`` takes. ``ParamGridBuilder`` makes such maps, too."""
    return [{estimator.getParam(name): value for name, value in c.items()} for c in candidates]


def rungs_of(n: int, keep: int = 2, most: int = 3) -> list[float]:
    """Shares of the full number of rounds that successive turns train with: the last is 1, each before it 1 / keep of the next."""
    turns = 1
    while turns < most and keep**turns <= n:
        turns += 1
    return [keep ** -(turns - 1 - i) for i in range(turns)]


def search_params(
    train: DataFrame, valid: DataFrame, features: list[str], candidates: list[dict], keep: int = 2, at_once: int = 4, y: str = "y", rungs: list[float] | None = None,
) -> DataFrame:
    """(trial, turn, rounds, params, rmse, best): boosted trees on the hold-out by successive halving; trial 0 has the defaults.

    All trials train a share of their rounds; the best one in ``keep`` goes on to the next turn with more, the last turn has
    all of them. Rows are prepared once and stored; a turn's trials are fitted ``at_once`` beside each other. ``best`` is the
    last turn's smallest error, ties by trial.
    """
    numeric, categorical = split_columns(train, features)
    stages, inputs, coded = preparation(numeric, categorical)
    ready = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs + coded, outputCol="features")]).fit(train)
    matrix = {name: stored(ready.transform(df).select("features", F.col(y).cast("double").alias("y"))) for name, df in (("train", train), ("valid", valid))}
    learner, log = boosted(), []
    trials = dict(enumerate([{}, *candidates]))
    rungs = rungs_of(len(trials), keep) if rungs is None else rungs
    for turn, share in enumerate(rungs):
        order = list(trials)
        rounds = {t: max(1, round(share * trials[t].get("maxIter", learner.getMaxIter()))) for t in order}
        fits = learner.fitMultiple(matrix["train"], param_maps(learner, [trials[t] | {"maxIter": rounds[t]} for t in order]))

        def one(_, fits=fits):
            i, model = next(fits)
            return i, model.transform(matrix["valid"]).agg(F.sqrt(F.avg((F.col("y_hat") - F.col("y")) ** 2))).first()[0]

        with ThreadPool(at_once) as pool:
            errors = {order[i]: e for i, e in pool.imap_unordered(one, order)}
        log += [(t, turn, rounds[t], json.dumps(trials[t], sort_keys=True), errors[t]) for t in order]
        best = sorted(order, key=lambda t: (errors[t], t))
        trials = {t: trials[t] for t in best[: max(1, -(-len(best) // keep))]} if turn < len(rungs) - 1 else {best[0]: {}}
    winner = next(iter(trials))
    rows = [(*r, r[0] == winner and r[1] == len(rungs) - 1) for r in log]
    return train.sparkSession.createDataFrame(rows, "trial int, turn int, rounds int, params string, rmse double, best boolean")


def search_space(n: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from the space of boosted-tree parameters."""
    import random

    draw = random.Random(seed)
    return [
        {"maxIter": draw.choice([20, 40, 60, 100]), "stepSize": round(10 ** draw.uniform(-2, -0.5), 4), "maxDepth": draw.randint(2, 7), "minInstancesPerNode": draw.choice([1, 5, 20]),
         "subsamplingRate": round(draw.uniform(0.5, 1.0), 2), "featureSubsetStrategy": draw.choice(["all", "0.5", "0.33"])}
        for _ in range(n)
    ]


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], key: str, y: str = "y", repeats: int = 5, seed: int = SEED) -> DataFrame:
    """(feature, importance): how much the RMSE rises when a feature's values are dealt to other rows, the mean of ``repeats`` deals.

    A deal pairs the rows in the order of ``key``, which tells them apart, with the rows in the order of a hash of it, both
    numbered without a task that holds them all. Rows of all features and deals are predicted in one pass.
    """
    rows = stored(positions(df.select(key, y, *features), [], [F.col(key)], "_n"))
    parts = [rows.select("*", F.lit(None).cast("string").alias("feature"), F.lit(0).alias("deal"))]
    for r in range(repeats):
        mixed = F.xxhash64(F.lit(seed + r), F.col(key))
        donors = positions(rows.select(key, *features), [], [mixed, F.col(key)], "_n").select("_n", F.struct(*features).alias("_from"))
        dealt = stored(rows.join(donors, "_n"))
        parts += [dealt.withColumn(f, F.col(f"_from.{f}")).drop("_from").withColumns({"feature": F.lit(f), "deal": F.lit(r)}) for f in features]
    scored = model.transform(reduce(DataFrame.unionByName, parts))
    errors = scored.groupBy("feature", "deal").agg(F.sqrt(F.avg((F.col("y_hat") - F.col(y)) ** 2)).alias("rmse"))
    errors = stored(errors)
    base = errors.where("feature is null").select(F.col("rmse").alias("base"))
    return errors.where("feature is not null").crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("rmse") - F.col("base")).alias("importance"))  # one row


def vector_widths(model: PipelineModel, df: DataFrame) -> dict[str, int]:
    """How many places each column of the pipeline's assembler takes in the vector, in order: level vectors take several."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    one = model.transform(df.limit(1)).select(*assembler.getInputCols()).first()
    return {c: len(one[c]) if hasattr(one[c], "toArray") else 1 for c in assembler.getInputCols()}


def gain_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, gain, share) of the pipeline's trees: each feature's summed gain over its columns of the vector."""
    return named_gain(trees_of(model), vector_widths(model, df))
