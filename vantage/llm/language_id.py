"""Language proportions of multilingual texts by expectation maximisation.

Training counts character trigrams of words by language, hashed into a fixed number of cells. A word's likelihood in a
language is the product over its trigrams. A text is a mixture: each word comes from one of its languages.
Expectation maximisation estimates the proportions; then single languages, pairs and triples of the likeliest ones are
compared by log-likelihood minus a penalty for each further language, and so on as long as a further language is better
for the text. The best set's largest language is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices

SPACE = 32


def letters_only(token: str) -> str:
    return token if token.isalpha() else "".join(c if c.isalpha() else " " for c in token)


def trigram_cells(words: list[str], n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every trigram of the words (a space stands before and after each), and the word that it is from.

    A word may hold spaces; trigrams around one are left out, so its parts count as words.
    """
    text = " " + "  ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9FB21C651E98DF25)
    cell = (mixed >> np.uint64(40)).astype(np.int64) % n_cells
    kept = (code[1:-1] != SPACE) & (owner[:-2] == owner[2:])
    return cell[kept], owner[1:-1][kept]


class MixtureModel:
    def __init__(self, languages: list[str], log_prob: np.ndarray, penalty: float, steps: int = 15, most_words: int = 300_000):
        self.languages, self.log_prob, self.penalty, self.steps, self.most_words = languages, log_prob, penalty, steps, most_words
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)), np.float32)

    def _index(self, tokens: list[list[str]]) -> None:
        """Learn the likelihoods of new tokens. A token without letters has a row of NaN."""
        if len(self.known) > self.most_words:
            self.known, self.rows = {}, self.rows[:0]
        new = list({t for row in tokens for t in row if t not in self.known})
        if not new:
            return
        cell, owner = trigram_cells([letters_only(t) for t in new], self.log_prob.shape[1])
        rows = np.stack([np.bincount(owner, p[cell], len(new)) for p in self.log_prob], 1).astype(np.float32)
        rows[np.bincount(owner, minlength=len(new)) == 0] = np.nan
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, rows])

    def _fit(self, like: np.ndarray, starts: np.ndarray, doc: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood (above the words' best single languages) of each text, over its allowed languages."""
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(self.steps):
            part = like * share[doc]
            part /= part.sum(1, keepdims=True)
            share = np.add.reduceat(part, starts, 0) / sizes[:, None]
        total = np.add.reduceat(np.log((like * share[doc]).sum(1) + 1e-30), starts).astype(float)
        return share, total

    def infer(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        """(language, its proportion, chosen languages, their proportions) of each text."""
        if not self.languages:
            return [("und", 0.0, [], [])] * len(texts)
        tokens = [(t or "").lower().split() for t in texts]
        self._index(tokens)
        known = self.known
        flat = np.fromiter((known[t] for row in tokens for t in row), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(row) for row in tokens])
        lettered = ~np.isnan(self.rows[flat, 0]) if len(flat) else np.zeros(0, bool)
        flat, doc = flat[lettered], doc[lettered]
        out: list = [("und", 0.0, [], [])] * len(texts)
        if not len(flat):
            return out
        sizes = np.bincount(doc, minlength=len(texts))
        some = np.flatnonzero(sizes)
        renumber = np.cumsum(sizes > 0) - 1
        doc, sizes = renumber[doc], sizes[some].astype(np.float32)
        rows = self.rows[flat]
        best = rows.max(1, keepdims=True)
        like = np.exp(rows - best)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        n, k = len(some), len(self.languages)
        share, _ = self._fit(like, starts, doc, sizes, np.ones((n, k), np.float32))
        order = np.argsort(-share, 1, kind="stable")
        single = np.add.reduceat((rows - best).astype(float), starts, 0)
        first = single.argmax(1)
        chosen = np.zeros((n, k), np.float32)
        chosen[np.arange(n), first] = 1
        value, result = single[np.arange(n), first], chosen.copy()
        cost = self.penalty * np.log(np.maximum(sizes, 2))
        rising = np.ones(n, bool)
        for size in range(2, k + 1):
            worth = np.flatnonzero(rising & (share[np.arange(n), order[:, size - 1]] > 0.01))
            if not len(worth):
                break
            sub = np.zeros(n, bool)
            sub[worth] = True
            held = sub[doc]
            allowed = np.zeros((len(worth), k), np.float32)
            np.put_along_axis(allowed, order[worth, :size], 1, 1)
            number = np.cumsum(sub) - 1
            sub_doc = number[doc[held]]
            got, total = self._fit(like[held], np.flatnonzero(np.diff(sub_doc, prepend=-1)), sub_doc, sizes[worth], allowed)
            total -= cost[worth] * (size - 1)
            better = total > value[worth]
            # a pair can be worse than the likeliest language although three are better: only from two on a fall ends the search
            rising[worth] = better | (size == 2)
            value[worth[better]], result[worth[better]] = total[better], got[better]
        for i, r in zip(some.tolist(), result, strict=True):
            top = np.argsort(-r, kind="stable")
            top = top[r[top] > 0]
            names = [self.languages[j] for j in top]
            shares = [min(1.0, float(r[j])) for j in top]
            out[i] = (names[0], shares[0], names, shares)
        return out


def train(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, mod: int, rest: int, docs_per_language: int, n_cells: int, smoothing: float,
) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probabilities of cells. Learns from about ``docs_per_language`` documents of each language, picked by hash."""
    learnt = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", mod) != rest)
    )
    sizes = {r["lang"]: r["count"] for r in learnt.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return [], np.zeros((0, n_cells))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))))
    picked = learnt.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                words = [letters_only(t) for text in part["text"] for t in text.lower().split()]
                cell, _ = trigram_cells(words, n_cells) if words else (np.zeros(0, np.int64), None)
                n = np.bincount(cell, minlength=n_cells)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": lang, "cell": at, "n": n[at]}), preserve_index=False)

    counts = picked.mapInArrow(count, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.zeros((len(languages), n_cells))
    table[counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counts["cell"].to_numpy(int)] = counts["n"].to_numpy(float)
    return languages, np.log((table + smoothing) / (table.sum(1, keepdims=True) + smoothing * n_cells))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 4, held_out_rest: int = 2,
    docs_per_language: int = 1500, n_cells: int = 1 << 16, smoothing: float = 0.05, penalty: float = 3.0,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions of every whole text.

    The classifier learns from a bounded sample: about ``docs_per_language`` documents of each language, of those whose
    crc32(id as text) mod ``held_out_mod`` isn't ``held_out_rest``. Its table (languages x ``n_cells`` numbers, a fixed
    size) is broadcast. Predictions are a map over the texts alone: no shuffle.

    Sets of languages are tried in the order of the proportions that all languages get together: the first, the first
    two, and so on, as long as the penalised likelihood rises and the next proportion is over 1 %.

    score: the predicted language's proportion. Null texts and texts without a letter: ``und``, 0. Nothing to learn
    from: ``und`` for all. Null ids and repeated rows are kept as they are. Empty table: no rows.
    """
    languages, log_prob = train(docs, id_col, text_col, lang_col, held_out_mod, held_out_rest, docs_per_language, n_cells, smoothing)
    shared = docs.sparkSession.sparkContext.broadcast((languages, log_prob.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MixtureModel(*shared.value, penalty)
        for batch in slices(batches, "text", 2 << 20):
            lang, score, names, shares = zip(*model.infer(batch.column("text").to_pylist()), strict=True)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, held_out_mod) == held_out_rest).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")
