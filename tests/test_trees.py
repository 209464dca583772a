"""Tree contributions against Shapley values over all subsets of features, worked out from the nodes."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from vantage.operators import trees

NAMES = ["a", "b", "c", "kind", "unused"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    data = []
    for i in range(400):
        a, b, c, kind = draw.random(), draw.randint(0, 5), draw.gauss(0, 1), draw.choice("pqrs")
        data.append((i, a, float(b), c, kind, 1.0, a * b + (3 if kind in "pr" else 0) * (c > 0) + draw.gauss(0, 0.1)))
    df = spark.createDataFrame(data, "id long, a double, b double, c double, level string, unused double, y double")
    df = StringIndexer(inputCol="level", outputCol="kind").fit(df).transform(df)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def expected(node, x, known):
    """The prediction when only the features of ``known`` are: other splits are taken by the share of training rows."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, sides = node.split(), (node.leftChild(), node.rightChild())
    f = split.featureIndex()
    if f in known:
        left = x[f] <= split.threshold() if split.getClass().getSimpleName() == "ContinuousSplit" else x[f] in set(split.leftCategories())
        return expected(sides[0 if left else 1], x, known)
    n = node.impurityStats().count()
    return sum(s.impurityStats().count() / n * expected(s, x, known) for s in sides)


def brute(parts, x):
    """parts: (root, weight)."""
    n = len(x)
    value = {s: sum(w * expected(r, x, s) for r, w in parts) for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
    return [sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n) * (value[s | {i}] - value[s]) for s in value if i not in s) for i in range(n)] + [value[frozenset()]]


MODELS = {
    "tree": lambda: DecisionTreeRegressor(labelCol="y", maxDepth=5, seed=1), "forest": lambda: RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=1),
    "boosted": lambda: GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.3, seed=1),
}


@pytest.mark.parametrize("kind", MODELS)
def test_equals_all_subsets(rows, kind):
    model = MODELS[kind]().fit(rows)
    scored = model.transform(rows)
    got = trees.tree_contributions(model, scored, "features", len(NAMES), ["id", "prediction"]).orderBy("id").collect()
    assert len(got) == 400 and all(r.c4 == 0 for r in got)
    assert max(abs(sum(r[f"c{i}"] for i in range(5)) + r.base_value - r.prediction) for r in got) < 1e-9
    members = [model] if kind == "tree" else model.trees
    weights = [1.0] if kind == "tree" else list(model.treeWeights)
    if kind == "forest":
        weights = [w / sum(weights) for w in weights]
    parts = [(t._call_java("rootNode"), w) for t, w in zip(members, weights, strict=True)]
    xs = {r.id: list(r.features.toArray()) for r in rows.where("id % 40 = 0").collect()}
    for r in got:
        if r.id in xs:
            assert [*(r[f"c{i}"] for i in range(5)), r.base_value] == pytest.approx(brute(parts, xs[r.id]), abs=1e-9)


def test_patterns_do_not_depend_on_the_number_of_rows(rows):
    """Few rows take the patterns that occur, many rows all of them: the values are the same."""
    model = MODELS["forest"]().fit(rows)
    paths = trees.ensemble_paths(model)
    x = np.array([r.features.toArray() for r in rows.limit(50).collect()])
    whole = trees.shapley_values(paths, x, 5)
    assert np.allclose(whole, np.vstack([trees.shapley_values(paths, x[i : i + 1], 5) for i in range(50)]))
    assert trees.shapley_values(paths, x[:0], 5).shape == (0, 6)


def test_a_feature_split_twice_is_one_step():
    a, b = trees.Step(0, 0.5, high=3.0), trees.Step(0, 0.2, low=1.0)
    assert a.narrowed(b) == trees.Step(0, 0.1, 1.0, 3.0)
    none = trees.Step(1, 0.5, levels=frozenset({1})).narrowed(trees.Step(1, 0.5, levels=frozenset({2})))
    assert none.levels == frozenset() and not none.follows(np.array([1.0, 2.0])).any()
    assert none.narrowed(trees.Step(1, 0.5)).levels == frozenset()


def test_no_rows_and_a_constant(rows):
    model = MODELS["tree"]().fit(rows.withColumn("y", F.lit(2.0)))
    assert trees.tree_contributions(model, rows.limit(0), "features", 5, ["id"]).count() == 0
    got = trees.tree_contributions(model, rows.limit(3), "features", 5, ["id"]).collect()
    assert all(r.base_value == 2.0 and all(r[f"c{i}"] == 0 for i in range(5)) for r in got)


def test_gain(rows):
    model = MODELS["boosted"]().fit(rows)
    table = {r.feature: r for r in trees.named_gain(model, {"a": 1, "b_filled": 1, "b_missing": 1, "kind_index": 1, "unused": 1}).collect()}
    raw = trees.total_gain(model)
    assert table["b"].gain == pytest.approx(raw.get(1, 0) + raw.get(2, 0)) and table["kind"].gain == pytest.approx(raw.get(3, 0)) and table["unused"].gain == 0
    assert sum(r.share for r in table.values()) == pytest.approx(1)


def test_values_of_patterns_are_worked_out_once_for_all_batches(monkeypatch):
    import pandas as pd

    paths = [(1.0 + i, (trees.Step(0, 0.5, high=0.1 * i), trees.Step(1, 0.25, low=0.2 * i))) for i in range(5)]
    calls, inner = [], trees.path_values
    monkeypatch.setattr(trees, "path_values", lambda *a: calls.append(1) or inner(*a))
    batches = [pd.DataFrame({"id": [i, i + 1], "_v": [np.array([0.1 * i, 0.5]), np.array([0.3, 0.2 * i])]}) for i in range(4)]
    got = list(trees._contributed(type("Shared", (), {"value": paths}), 2, ["id"], ["c0", "c1"])(iter(batches)))
    assert len(calls) == len(paths)
    for batch, out in zip(batches, got, strict=True):
        assert np.array_equal(out[["c0", "c1", "base_value"]].to_numpy(), trees.shapley_values(paths, np.stack(batch["_v"].to_numpy()), 2))
