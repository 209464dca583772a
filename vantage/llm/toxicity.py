"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each is a logistic model of the words and word beginnings in a text and of
the log-odds that the chain gave to the categories before. A model in the chain is trained with out-of-fold predictions
of those before it, so that it sees them as good as they will be on new texts, not as good as on their training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

N_CELLS = 1 << 22


def token_features(token: str) -> tuple[int, ...]:
    """Cells of a token: its letters as a word, and the word's first four to six letters. A token without letters has its signs."""
    word = "".join(c for c in token if c.isalpha()) or "#" + token[:8]
    return tuple(crc32(x.encode()) % N_CELLS for x in dict.fromkeys([word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]))


class Features:
    """The distinct cells of a text, if wanted only those that matter; remembers tokens."""

    def __init__(self, wanted: frozenset[int] | None = None, most_tokens: int = 100_000):
        self.wanted, self.most_tokens, self.known = wanted, most_tokens, {}

    def cells(self, text: str | None) -> set[int]:
        known, wanted = self.known, self.wanted
        tokens = set((text or "").lower().split())
        for t in tokens:
            if t not in known:
                found = token_features(t)
                known[t] = found if wanted is None else tuple(f for f in found if f in wanted)
        out = {f for t in tokens for f in known[t]}
        if len(known) > self.most_tokens:
            known.clear()
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """L2-regularised logistic regression on the ``n_features`` cells that tell most by chi-squared, and on dense columns."""

    def __init__(self, n_features: int = 1500, strength: float = 1e-4, steps: int = 150, rate: float = 0.3):
        self.n_features, self.strength, self.steps, self.rate = n_features, strength, steps, rate

    def fit(self, row: np.ndarray, cell: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        n, positive = len(y), y.sum()
        having, both = np.bincount(cell), np.bincount(cell, y[row])
        expected = having * positive / max(n, 1)
        spread = expected * (1 - positive / max(n, 1)) * (1 - having / max(n, 1))
        chi = np.where((having >= 3) & (spread > 0), (both - expected) ** 2 / np.maximum(spread, 1e-9), 0)
        self.cells = np.sort(np.argsort(-chi, kind="stable")[: self.n_features])
        self.cells = self.cells[chi[self.cells] > 3.84]  # the 5 % point
        at = np.searchsorted(self.cells, cell)
        kept = (at < len(self.cells)) & (np.append(self.cells, -1)[at] == cell)
        row, at = row[kept], at[kept]
        size = len(self.cells)
        weight, tilt, bias = np.zeros(size), np.zeros(dense.shape[1]), float(_logit(np.array(positive / max(n, 1))))
        moved = [np.zeros(size), np.zeros(dense.shape[1]), 0.0]
        for _ in range(self.steps if 0 < positive < n else 0):
            off = (_sigmoid(bias + np.bincount(row, weight[at], n) + dense @ tilt) - y) / n
            for i, g in enumerate((np.bincount(at, off[row], size) + self.strength * weight, dense.T @ off + self.strength * tilt, off.sum())):
                moved[i] = moved[i] + g * g
                step = self.rate * g / (np.sqrt(moved[i]) + 1e-8)
                if i == 0:
                    weight = weight - step
                elif i == 1:
                    tilt = tilt - step
                else:
                    bias -= float(step)
        self.weight, self.tilt, self.bias = weight, tilt, bias
        return self

    def predict(self, row: np.ndarray, cell: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.cells, cell)
        kept = (at < len(self.cells)) & (np.append(self.cells, -1)[at] == cell)
        return _sigmoid(self.bias + np.bincount(row[kept], self.weight[at[kept]], n) + dense @ self.tilt)


class Chain:
    def __init__(self, n_folds: int = 5):
        self.n_folds = n_folds
        self.links: list[Linear] = []

    def fit(self, rows: list[np.ndarray], fold: np.ndarray, labels: np.ndarray) -> Chain:
        """rows: each text's cells; fold: of each text; labels: texts x categories."""
        n = len(rows)
        row, cell = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int32)
        often = np.bincount(cell, minlength=N_CELLS) >= 3  # cells of one or two texts tell nothing
        kept, known = often[cell], np.flatnonzero(often)
        row, cell = row[kept], (np.cumsum(often) - 1).astype(np.int32)[cell[kept]]
        dense = np.zeros((n, 0))
        for y in labels.T.astype(float):
            held = np.zeros(n)
            for k in range(self.n_folds):
                out = fold == k
                number = np.cumsum(~out) - 1
                inside = ~out[row]
                model = Linear().fit(number[row[inside]], cell[inside], dense[~out], y[~out])
                held[out] = model.predict(row, cell, dense, n)[out]
            self.links.append(Linear().fit(row, cell, dense, y))
            dense = np.column_stack([dense, _logit(held)])
        for link in self.links:
            link.cells = known[link.cells]
        return self

    def predict(self, rows: list) -> np.ndarray:
        n = len(rows)
        row = np.repeat(np.arange(n), [len(r) for r in rows])
        cell = np.fromiter((c for r in rows for c in r), np.int64)
        dense, out = np.zeros((n, 0)), []
        for link in self.links:
            p = link.predict(row, cell, dense, n)
            out.append(p)
            dense = np.column_stack([dense, _logit(p)])
        return np.column_stack(out)

    def cells(self) -> frozenset[int]:
        return frozenset(int(c) for link in self.links for c in link.cells)


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, rows_per_class: int, class_col: Column, n_folds: int,
) -> Chain:
    """Fit the chain on about ``rows_per_class`` labelled documents of each class, picked by hash of the id."""
    labels = labels.select(F.col("doc_id"), *(c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())), class_col.cast("int").alias("cls"))
    ys = [f"y{i}" for i in range(len(categories))]
    labels = labels.dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in [*ys, "cls"]))  # where labels of an id differ, the worse holds
    sizes = {r["cls"]: r["count"] for r in labels.groupBy("cls").count().collect()}  # a row a class
    names = [f"y{i}" for i in range(len(categories))]
    chain = Chain(n_folds)
    if not sizes:
        return chain.fit([], np.zeros(0, int), np.zeros((0, len(names))))
    share = F.create_map(*(x for cls, n in sizes.items() for x in (F.lit(cls), F.lit(min(1.0, rows_per_class / n)))))
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 20)) < share[F.col("cls")] * (1 << 20)).drop("cls")
    # a bounded sample: about rows_per_class rows of each class, one text an id
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id", *ys).agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([crc32(t.encode()) % n_folds for t in texts], pa.int32()), pa.array([sorted(features.cells(t)) for t in texts], pa.list_(pa.int32())), *(batch.column(y) for y in names)],
                ["doc_id", "fold", "cells", *names],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(extract, f"doc_id {kind}, fold int, cells array<int>, " + ", ".join(f"{y} int" for y in names)).toArrow().sort_by("doc_id")
    cells = found.column("cells").combine_chunks()
    edges = cells.offsets.to_numpy()
    rows = np.split(cells.values.to_numpy(), edges[1:-1]) if found.num_rows else []
    return chain.fit(rows, found.column("fold").to_numpy(), np.column_stack([found.column(y).to_numpy() for y in names]))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows_per_class: int, n_folds: int):
    """The fitted chain as a broadcast, and its categories' names."""
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    categories = {"p_poor": poor, "p_toxic": toxic, "p_toxic_and_poor": toxic & poor}
    chain = train_chain(docs, labels, categories, id_col, text_col, rows_per_class, F.col("toxic"), n_folds)
    return docs.sparkSession.sparkContext.broadcast(chain), list(categories)


def _judge(model: Chain, features: Features, texts: pa.Array, threshold: float) -> tuple[np.ndarray, pa.Array]:
    """Probabilities, and whether each text is toxic."""
    p = model.predict([features.cells(t) for t in texts.to_pylist()])
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
    return p, pa.compute.and_(pa.array(p[:, 1] >= threshold), pa.compute.greater(lengths, 0))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = 4000, n_folds: int = 5, threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` doesn't call toxic, all columns as they are: a map without a shuffle."""
    shared, _ = _fitted(docs, labels, id_col, text_col, rows_per_class, n_folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.cells())
        for batch in slices(batches, text_col):
            yield batch.filter(pa.compute.invert(_judge(model, features, batch.column(text_col), threshold)[1]))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = 4000, n_folds: int = 5,
    threshold: float = 0.5,
) -> DataFrame:
    """doc_id, p_poor, p_toxic, p_toxic_and_poor, toxic of every whole text.

    The chain has the categories poor (labels.quality = 0), toxic (labels.toxic = 1) and both. It learns from a bounded
    sample, about ``rows_per_class`` toxic and as many other labelled documents; features and fits are on this sample
    alone, on the driver. The chosen cells' weights (3 x 1500 numbers at most) go to the executors, where scoring is a
    map: no shuffle.

    toxic: p_toxic >= ``threshold``. Null and empty texts have no words, get the chain's base rates, and are never
    called toxic. Without labels no document is toxic. Null labels aren't learnt from; of repeated labels of an id that
    differ, the worse are; of rows that share an id, the least text. Null ids and repeated documents are kept as they are. Empty table: no rows.
    """
    shared, names = _fitted(docs, labels, id_col, text_col, rows_per_class, n_folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.cells())
        for batch in slices(batches, "text"):
            p, toxic = _judge(model, features, batch.column("text"), threshold)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c) for c in p.T), toxic], ["doc_id", *names, "toxic"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, p_poor double, p_toxic double, p_toxic_and_poor double, toxic boolean")
