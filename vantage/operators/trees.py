"""Why a tree ensemble predicts what it predicts: exact Shapley values along the trees' own paths, and split gain by feature.

A leaf is reached through splits on m features. For a set of known features its part of the expected prediction is its
value times, for each known feature, 1 or 0 (the row follows the path there or not) and, for each other one, the share of
training rows that do. So the sums over subsets that Shapley values ask for are coefficients of a product of m - 1 linear
factors: polynomial work a leaf, whatever the number of subsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One feature of a path: which values follow it (above ``low`` to ``high``, or one of ``levels``), and the share of training rows that do."""

    feature: int
    share: float
    low: float = -np.inf
    high: float = np.inf
    levels: frozenset | None = None

    def follows(self, x: np.ndarray) -> np.ndarray:
        if self.levels is not None:
            return np.isin(x, list(self.levels))
        return x <= self.high if self.low == -np.inf else x > self.low if self.high == np.inf else (x > self.low) & (x <= self.high)

    def narrowed(self, other: Step) -> Step:
        levels = self.levels if other.levels is None else other.levels if self.levels is None else self.levels & other.levels
        return Step(self.feature, self.share * other.share, max(self.low, other.low), min(self.high, other.high), levels)


Path = tuple[float, tuple[Step, ...]]  # a leaf's value and the features that lead to it, each once


def tree_paths(tree, weight: float = 1.0) -> list[Path]:
    """The paths of a fitted tree of pyspark.ml, leaf values multiplied by ``weight``. Shares are of the rows that trained it."""
    out: list[Path] = []

    def walk(node, steps: dict[int, Step]) -> None:
        if node.subtreeDepth() == 0:
            out.append((weight * node.prediction(), tuple(steps.values())))
            return
        split, n = node.split(), node.impurityStats().count()
        f = split.featureIndex()
        sides = [node.leftChild(), node.rightChild()]
        shares = [side.impurityStats().count() / n for side in sides]
        if split.getClass().getSimpleName() == "ContinuousSplit":
            limit = split.threshold()
            own = [Step(f, shares[0], high=limit), Step(f, shares[1], low=limit)]
        else:
            own = [Step(f, share, levels=frozenset(levels)) for share, levels in zip(shares, (split.leftCategories(), split.rightCategories()), strict=True)]
        for side, step in zip(sides, own, strict=True):
            walk(side, steps | {f: steps[f].narrowed(step) if f in steps else step})

    walk(tree._call_java("rootNode"), {})
    return out


def ensemble_paths(model) -> list[Path]:
    """The paths of a forest (which takes the mean), of boosted trees (a weighted sum) or of a single tree; of a list of forests, those of their mean over all trees."""
    if isinstance(model, list) and len(model) > 1:
        total = sum(len(m.trees) for m in model)
        return [p for m in model for tree in m.trees for p in tree_paths(tree, 1 / total)]
    model = model[0] if isinstance(model, list) else model
    if not hasattr(model, "trees"):
        return tree_paths(model)
    weights = list(model.treeWeights)
    if not hasattr(model, "getStepSize"):
        weights = [w / sum(weights) for w in weights]
    return [p for tree, w in zip(model.trees, weights, strict=True) for p in tree_paths(tree, w)]


def expected_value(paths: list[Path]) -> float:
    return float(sum(value * np.prod([s.share for s in steps]) for value, steps in paths))


def path_values(shares: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1: a row for each row of ``follows`` (0 or 1 a feature), a column for each feature.

    Column i is (o_i - z_i) times the sum over k of c_k k! (m - 1 - k)! / m!, c_k being the coefficient of x^k in the product
    over j other than i of (z_j + o_j x).
    """
    rows, m = follows.shape
    out = np.empty((rows, m))
    weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    for i in range(m):
        poly = np.zeros((rows, m))
        poly[:, 0] = 1.0
        for j in (j for j in range(m) if j != i):
            raised = np.zeros_like(poly)
            raised[:, 1:] = poly[:, :-1] * follows[:, j : j + 1]
            poly = poly * shares[j] + raised
        out[:, i] = (follows[:, i] - shares[i]) * (poly @ weights)
    return out


MOST_PATTERNS = 1 << 12  # of a path, for which values are worked out before the rows are seen


def pattern_values(path: Path, patterns: np.ndarray) -> np.ndarray:
    """A path's Shapley values: a row for each feature of it, a column for each pattern, whose bits say at which features a row follows."""
    value, steps = path
    return np.ascontiguousarray(value * path_values(np.array([s.share for s in steps]), (patterns[:, None] >> np.arange(len(steps)) & 1).astype(float)).T)


def pattern_tables(paths: list[Path]) -> list[np.ndarray | None]:
    """The values of all patterns of each path; none where there are too many."""
    return [pattern_values(p, np.arange(1 << len(p[1]))) if p[1] and 1 << len(p[1]) <= MOST_PATTERNS else None for p in paths]


def shapley_values(paths: list[Path], x: np.ndarray, n_features: int, tables: list | None = None) -> np.ndarray:
    """Contributions of each row's features (columns), the expected prediction in the last column; a row sums to its prediction.

    Rows that follow a path at the same features have the same values: they are worked out once for each such pattern, by
    ``tables`` (of ``pattern_tables``) once for all batches.
    """
    out = np.zeros((n_features + 1, len(x)))
    out[-1] = expected_value(paths)
    columns = np.ascontiguousarray(x.T)
    for path, known in zip(paths, tables or [None] * len(paths), strict=True):
        steps = path[1]
        if not steps or not len(x):
            continue
        bits = np.zeros(len(x), np.uint16 if known is not None else np.int64)
        for j, step in enumerate(steps):
            bits |= step.follows(columns[step.feature]).astype(bits.dtype) << bits.dtype.type(j)
        if known is None:
            patterns, bits = np.unique(bits, return_inverse=True)
            known = pattern_values(path, patterns)
        for step, values in zip(steps, known, strict=True):
            out[step.feature] += values[bits]
    return out.T


def tree_contributions(model, df: DataFrame, vector: str, n_features: int, keep: list[str]) -> DataFrame:
    """``keep``, c0, c1, ... and base_value: each feature's exact path-dependent Shapley value; with the base they sum to the prediction.

    The ensemble's paths, bounded by its number of leaves, are broadcast; rows are worked on in Arrow batches, without a
    shuffle. Features that no split uses have 0. An empty table gives no rows.
    """
    paths = df.sparkSession.sparkContext.broadcast(ensemble_paths(model))
    names = [f"c{i}" for i in range(n_features)]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{n} double" for n in names), "base_value double"])
    return df.select(*keep, vector_to_array(vector).alias("_v")).mapInPandas(_contributed(paths, n_features, keep, names), schema)


def _contributed(paths, n_features: int, keep: list[str], names: list[str]) -> Callable:
    import pandas as pd

    def run(batches: Iterator) -> Iterator:
        tables = pattern_tables(paths.value)
        for batch in batches:
            x = np.stack(batch["_v"].to_numpy()) if len(batch) else np.zeros((0, n_features))
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(shapley_values(paths.value, x, n_features, tables), columns=[*names, "base_value"])], axis=1)

    return run


def total_gain(model) -> dict[int, float]:
    """Each feature's summed gain over all splits of all trees: what a split lowers the impurity by, times its training rows."""
    gains: dict[int, float] = {}
    parts = model if isinstance(model, list) else [model]
    waiting = [t._call_java("rootNode") for m in parts for t in (m.trees if hasattr(m, "trees") else [m])]
    while waiting:
        node = waiting.pop()
        if node.subtreeDepth() == 0:
            continue
        f = node.split().featureIndex()
        gains[f] = gains.get(f, 0.0) + node.gain() * node.impurityStats().count()
        waiting += [node.leftChild(), node.rightChild()]
    return gains


def feature_of(column: str) -> str:
    """The feature that a column of the vector was made from."""
    return next((column.removesuffix(s) for s in ("_filled", "_missing", "_index", "_hot") if column.endswith(s)), column)


def named_gain(model, widths: dict[str, int]) -> DataFrame:
    """(feature, gain, share), the largest first: gain summed over a feature's columns. ``widths``: columns of the vector in order, and their places."""
    gains, at, totals = total_gain(model), 0, {}
    for column, width in widths.items():
        totals[feature_of(column)] = totals.get(feature_of(column), 0.0) + sum(gains.get(i, 0.0) for i in range(at, at + width))
        at += width
    whole = sum(totals.values()) or 1.0
    rows = [(f, g, g / whole) for f, g in totals.items()]
    return SparkSession.active().createDataFrame(rows, "feature string, gain double, share double").orderBy(F.desc("gain"), "feature")
