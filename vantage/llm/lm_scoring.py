"""N-gram scores of texts by a weighted backoff automaton.

Model. With c the training count of an n-gram, h a history, h' the history without its first word and k the
concentration: p(w | h) = (c(h w) + k p(w | h')) / (c(h) + k), a hierarchical Dirichlet smoothing that needs counts
only. Words alone: p(w) = c(w) / (N + u), and u / (N + u) for the class of unknown words, with N training tokens. Each
level sums to one.

Automaton. A state is a history that training has; its arcs are the words that followed it there, with weight
log10 p(w | h); its failure arc leads to h' with weight log10(k / (c(h) + k)). The root has an arc for each known word
and one for unknown words. A walk from left to right carries the state: follow the word's arc, or fail until there is
one, adding up weights; a word's arc leads to the longest history that is a state.

At scale. N-grams grow with the corpus, so no table of them goes to one place. Documents are dealt by hash into blocks
of a few MB. (1) Each block sorts its distinct n-grams by hash and sends each bucket of the hash range what falls into
it, packed: so an n-gram costs a block once, however often it occurs, and a frequent one costs its bucket one entry a
block. (2) Each bucket adds up the training counts and answers each block for just the n-grams that it asked for.
(3) Each block, with its answers, has the part of the automaton that its own texts can reach, and walks its texts.
Blocks and buckets grow in number, not in size; texts are shuffled once. Words are compared as bytes; longer n-grams by
64-bit hashes, of which two may coincide (about n**2 / 2**65 pairs of n), which then share a count.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, crc_mod, cut

BEGIN, END = b" begin", b" end"  # no word holds a space
ROOT = 0


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; ``bytes.split`` cuts at just the six separators."""
    return (text or "").encode().lower().split()


class Block:
    """The n-grams of some texts. Level n has the sorted distinct hashes of its n-grams; level 1 the words in that order."""

    def __init__(self, texts: list[str | None], order: int):
        rows = [[BEGIN, *words_of(t), END] for t in texts]
        flat = list(chain.from_iterable(rows))
        words = list({BEGIN, END}.union(flat))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        by_hash = np.argsort(hashes, kind="stable")
        if len(words) > 1 and (np.diff(hashes[by_hash]) == 0).any():  # words that share a hash are in the order of their bytes
            by_hash = np.array(sorted(range(len(words)), key=lambda i: (hashes[i], words[i])))
        self.words, self.hashes = [words[i] for i in by_hash.tolist()], hashes[by_hash]
        rank = dict(zip(self.words, range(len(words)), strict=True))
        begin, end = rank[BEGIN], rank[END]
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.tokens = np.fromiter(map(rank.__getitem__, flat), np.int64, len(flat))  # each text: begin, words, end
        self.begin, self.end = begin, end
        self.doc = np.repeat(np.arange(len(rows)), self.sizes)
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # of each level from 1: distinct keys; at which positions one ends; which of the keys it is there
        self.keys, self.ends, self.which = [self.hashes], [np.arange(len(self.tokens))], [self.tokens]
        key = self.hashes[self.tokens]
        for n in range(2, order + 1):
            ends = np.flatnonzero(place >= n - 1)
            longer = np.zeros(len(key), np.uint64)
            longer[ends] = (key[ends - 1] * np.uint64(0x9E3779B97F4A7C15) ^ (key[ends - 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + self.hashes[self.tokens[ends]] * np.uint64(0x94D049BB133111EB)
            longer ^= longer >> np.uint64(31)
            key = longer
            keys, which = np.unique(key[ends], return_inverse=True)
            self.keys.append(keys)
            self.ends.append(ends)
            self.which.append(which)

    def counts(self, docs: np.ndarray) -> list[np.ndarray]:
        """Of each level, how often each n-gram occurs in the texts where ``docs`` is true."""
        return [np.bincount(w[docs[self.doc[e]]], minlength=len(k)) for k, e, w in zip(self.keys, self.ends, self.which, strict=True)]


class Automaton:
    """The part of the model's automaton that a block's texts can reach.

    States are numbered level by level from the root, 0. ``at[n]`` says which of level n's n-grams ends at a position of
    the block (-1: none), so that a state's arc for the next word is found by number.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], n_tokens: int, concentration: float, unknown: float):
        self.block, self.order = block, len(block.keys)
        self.known = [t > 0 for t in totals]
        self.known[0] = self.known[0] & (np.arange(len(block.words)) != block.begin)  # the begin mark is a history, never a word to predict
        self.at = []
        for ends, which in zip(block.ends, block.which, strict=True):
            index = np.full(len(block.tokens), -1)
            index[ends] = which
            self.at.append(index)
        prob = np.where(totals[0] > 0, totals[0], unknown) / (n_tokens + unknown)
        self.unknown = float(np.log10(unknown / (n_tokens + unknown)))
        self.weights, self.state_of = [np.log10(prob)], []
        fail, fail_weight, n_states = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        suffix = np.zeros(len(block.words), np.int64)
        for level in range(self.order):
            if level:
                place = np.full(len(totals[level]), -1)
                place[block.which[level]] = block.ends[level]  # some position where the n-gram ends
                prefix, suffix = self.at[level - 1][place - 1], self.at[level - 1][place]
                prob = (totals[level] + concentration * prob[suffix]) / (totals[level - 1][prefix] + concentration)
                self.weights.append(np.log10(prob))
            if level < self.order - 1:
                has = totals[level] > 0
                ids = np.where(has, n_states + np.cumsum(has) - 1, -1)
                fail.append(self.state_of[level - 1][suffix[has]] if level else np.zeros(int(has.sum()), np.int64))
                fail_weight.append(np.log10(concentration / (totals[level][has] + concentration)))
                n_states += int(has.sum())
                self.state_of.append(ids)
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)

    def _arc(self, level: int, where: np.ndarray) -> np.ndarray:
        """The number of the arc that a state of this level has for the word at each position; -1: none."""
        arc = self.at[level][where]
        return np.where((arc >= 0) & self.known[level][arc], arc, -1)

    def scores(self) -> np.ndarray:
        """log10 of the probability of each text's words and end, in one walk from the begin mark.

        The state before a word is fixed by the words before it, so that the walk's steps can be taken side by side:
        each word starts in the state that the word before left, and follows failure arcs until there is an arc for it.
        """
        block = self.block
        where = np.flatnonzero(block.tokens != block.begin)
        level, state, total = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64), np.zeros(len(where))
        for n, ids in enumerate(self.state_of):
            history = self.at[n][where - 1]
            left = np.where(history >= 0, ids[history], -1)
            level[left >= 0], state[left >= 0] = n + 1, left[left >= 0]
        for n in range(self.order - 1, -1, -1):
            here = np.flatnonzero(level == n)
            arc = self._arc(n, where[here])
            total[here[arc >= 0]] += self.weights[n][arc[arc >= 0]]
            lost = here[arc < 0]
            if n:
                total[lost] += self.fail_weight[state[lost]]
                state[lost], level[lost] = self.fail[state[lost]], n - 1
            else:
                total[lost] += self.unknown
        return np.bincount(block.doc[where], total, len(block.sizes))

    def walk(self, start: int, end: int) -> float:
        """The same for the positions from ``start`` (a begin mark) to ``end``, word by word with the state carried along."""
        level = next((n + 1 for n, ids in reversed(list(enumerate(self.state_of))) if self.at[n][start] >= 0 and ids[self.at[n][start]] >= 0), 0)
        state = int(self.state_of[level - 1][self.at[level - 1][start]]) if level else 0
        total = 0.0
        for i in range(start + 1, end):
            while (arc := int(self._arc(level, np.array([i]))[0])) < 0 and level:
                total += self.fail_weight[state]
                state, level = int(self.fail[state]), level - 1
            if arc < 0:
                total += self.unknown
                continue
            total += self.weights[level][arc]
            level = min(level + 1, self.order - 1)  # the arc's history, or its longest end that is short enough
            state = int(self.state_of[level - 1][self.at[level - 1][i]]) if level else 0
        return total


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, "<u4").tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)


def _bucket_edges(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that have keys, and where each begins in the sorted keys (with the end)."""
    bucket = (keys >> np.uint64(32)).astype(np.int64) * n_buckets >> 32
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[at], np.append(at, len(keys))


ASKED = "bucket int, block int, level int, keys binary, counts binary"
ANSWERED = "block int, level int, bucket int, counts binary, types bigint"


def _ask(order: int, n_buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block_id = table.column("block")[0].as_py()
        block = Block(table.column("text").to_pylist(), order)
        rows = []
        for level, (keys, found) in enumerate(zip(block.keys, block.counts(np.array(table.column("train").to_pylist(), bool)), strict=True)):
            buckets, edges = _bucket_edges(keys, n_buckets)
            for b, start, end in zip(buckets.tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
                body = b"\n".join(block.words[start:end]) if level == 0 else keys[start:end].astype("<u8").tobytes()
                rows.append((b, block_id, level, body, _pack(found[start:end])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "level", "keys", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Add up a bucket's counts over all blocks, and tell each block the totals of its n-grams, in its own order."""
    asked = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "block", "keys", "counts")), strict=True), key=lambda r: r[:2])
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for level in sorted({r[0] for r in asked}):
        part = [r for r in asked if r[0] == level]
        found = [_unpack(r[3]) for r in part]
        if level == 0:
            number: dict[bytes, int] = defaultdict(count().__next__)
            which = [np.array([number[w] for w in r[2].split(b"\n")], np.int64) for r in part]
            size = len(number)
        else:
            sizes = [len(f) for f in found]
            keys, flat = np.unique(np.concatenate([np.frombuffer(r[2], "<u8") for r in part]), return_inverse=True)
            which, size = np.split(flat, np.cumsum(sizes)[:-1]), len(keys)
        totals = np.bincount(np.concatenate(which), np.concatenate(found), size).astype(np.int64)
        rows += [(r[1], level, bucket, _pack(totals[w]), None) for r, w in zip(part, which, strict=True)]
        if level == 0:
            totals[[i for w, i in number.items() if w == BEGIN]] = 0
            rows.append((-1 - bucket % 256, 0, bucket, b"", int((totals > 0).sum())))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "level", "bucket", "counts", "types"])


SCORED = ["held_out", "n_tokens", "n_known", "base_sum", "score", "types"]


def _score(order: int, n_tokens: int, concentration: float, unknown: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A row for each text; and a row without id for the words that buckets have counted."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names, ids = ["doc_id", *SCORED], texts.column("doc_id").type
        if not texts.num_rows:
            counted = pa.compute.sum(answers.column("types")).as_py()
            return pa.table([pa.array([x], t) for x, t in zip((None, None, None, None, None, None, counted), (ids, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names)
        block = Block(texts.column("text").to_pylist(), order)
        got: list[list] = [[] for _ in range(order)]
        for level, _, packed in sorted(zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "counts")), strict=True)):
            got[level].append(_unpack(packed))
        totals = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in got]
        predicted = block.tokens != block.begin
        doc, seen = block.doc[predicted], totals[0][block.tokens[predicted]]
        base = np.bincount(doc, np.log10(seen + 1), len(block.sizes))
        known = np.bincount(doc, seen > 0, len(block.sizes)).astype(np.int64)
        scores = Automaton(block, totals, n_tokens, concentration, unknown).scores()
        held_out = pa.compute.invert(texts.column("train").combine_chunks())
        return pa.table([texts.column("doc_id"), held_out, pa.array(block.sizes - 1), pa.array(known), pa.array(base), pa.array(scores), pa.nulls(len(known), pa.int64())], names)

    return run


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 7, held_out_rest: int = 2,
    order: int = 2, concentration: float = 300.0, unknown: float = 0.5, block_bytes: int = 4 << 20,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Counts come from the documents whose crc32(id as text) mod ``held_out_mod`` isn't ``held_out_rest``.
    base_score: add-one unigrams; score: the automaton of n-grams up to ``order``.

    Null and empty texts have one token, the end. A null id counts as an empty id in the split. Repeated rows are
    learnt from and scored each. Without training documents N = V = 0, all tokens are unknown, base_score and score are 0.
    Empty table: no rows. Other columns are ignored.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    train = crc_mod(id_col, held_out_mod) != held_out_rest
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN)) + 1
    size, n_tokens = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.coalesce(F.sum(F.when(train, words)), F.lit(0))).first()
    n_blocks = max(1, -(-size // block_bytes))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int").alias("block"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    answers = rows.groupBy("block").applyInArrow(_ask(order, n_blocks), ASKED).groupBy("bucket").applyInArrow(_answer, ANSWERED)
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, n_tokens, concentration, unknown), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_sum double, score double, types bigint"
    )
    scored = cut(scored)
    n_words = scored.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(float(n_tokens + n_words + 1)))
    return scored.where("types is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score"
    )
