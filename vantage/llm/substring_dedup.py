"""Repeated passages across documents, exact or with small edits, by collinear chaining of shared word k-mers.

Seeds. In each window of neighbouring k-mers the one with the smallest hash is a seed, so that two copies of a run of
words have the same seeds. Occurrences of a seed are joined with its first one (smallest document, then position), not
with each other: a passage in n documents gives n - 1 links a seed. Where neighbouring seeds of a document lead to several
documents or places, all seeds of a stretch of ``min_words`` - ``window`` words together are a second kind of seed, which is
joined with its own first occurrence. Where this finds no passage over a seed, any two seeds of ``min_words`` words whose first
occurrences don't lie so near each other are a third kind, whatever lies between them. So documents that share a passage are compared even if each of its lines
and phrases occurs earlier somewhere else, and if words between them were changed. Not seen is a passage of which every such
stretch and pair occurs in a still earlier document, there with too little around it to be a passage.

Chains. Of two documents, the seeds that lie in the same order in both are chained: a chain's score is the seeds' worth
less a cost for the gaps on both sides, and a Fenwick tree over the source's positions gives each seed its best
predecessor. Several chains of a pair are taken, best first.

Alignment. A chain is extended to both sides word by word while matches outweigh mismatches, and the words between its
ends are aligned by their longest common subsequence. Long and alike enough, it is a repeated passage. A chain that isn't
alike enough as a whole can hold several passages with foreign words between: its longest parts that are alike are taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, few_items, few_rows, fresh_name, hot_keys, likely_among, salted_join, slices, written
from .lm_scoring import words_of
from .near_dedup import _GOLD, mix

_WORD = re.compile(WORD_PATTERN)
GRID, MARGIN = 64, 64
MOST_CELLS = 1 << 28  # of a gap between two seeds: larger ones are aligned at their ends only


def seeds_of(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the minimisers of a text's word hashes."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = kmers(words, k)
    view = np.lib.stride_tricks.sliding_window_view(code, min(window, n))
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at, code[at]


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words (as ``words_of`` gives them) after each other, and where each text's words begin and the last one's end."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    ends, raw = ends - ends[0], bytes(texts.buffers()[2][ends[0] : ends[-1]] if ends[-1] > ends[0] else b"").lower()
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    begins = ~space
    begins[1:] &= space[:-1]
    own = ends[ends < len(raw)]
    begins[own] = ~space[own]
    begins = np.flatnonzero(begins)
    # a word goes on to the next one's begin: the white space between is taken off where the words are distinct
    spans = pa.py_buffer(np.append(begins, len(raw)))
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, spans, pa.py_buffer(raw)]).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.strip()) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return known[words.indices.to_numpy()], np.searchsorted(begins, ends)


def seeds_in(texts: pa.Array, min_words: int, k: int, window: int) -> tuple[pa.Array, pa.Array]:
    """Positions and hashes of the minimisers of each text, as ``seeds_of`` finds them; null for texts of fewer than ``min_words`` words."""
    words, ends = words_in(texts)
    sizes = np.diff(ends)
    if min_words < k + window - 1:  # shorter texts than a window
        found = [seeds_of(words[i : j if j - i >= min_words else i], k, window) for i, j in zip(ends, ends[1:], strict=False)]
        counts = np.array([len(p) for p, _ in found], np.int64)
        at, codes = (np.concatenate(x) for x in zip(seeds_of(words[:0], k, window), *found, strict=True))
    else:
        left = np.repeat(ends[1:], sizes) - np.arange(len(words))  # words left in the text
        codes = kmers(words, k)
        at = least_of(codes, window)
        at = at[(left[: len(at)] >= k + window - 1) & (np.repeat(sizes, sizes)[: len(at)] >= min_words)]
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at  # neighbouring windows often have one in common
        codes = codes[at]
        counts = np.diff(np.searchsorted(at, ends))
        at = at - np.repeat(ends[:-1], counts)
    lists, short = pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(sizes < min_words)
    return tuple(pa.ListArray.from_arrays(lists, pa.array(x), mask=short) for x in (at.astype(np.int32), codes.view(np.int64)))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` words on end."""
    code = np.full(max(len(words) - k + 1, 0), np.uint64(k))
    for i in range(k):
        code = mix(code * _GOLD + words[i : len(code) + i])
    return code


def least_of(code: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest (of equal ones the first) of each ``window`` hashes on end stands."""
    least, at, wide = code, np.arange(len(code)), 1
    while wide < window:
        step = min(wide, window - wide)  # windows of ``wide``, and those ``step`` on, which go over each other at the last step
        n = max(len(least) - step, 0)
        right = least[step:] < least[:n]
        least, at, wide = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n]), wide + step
    return at


def chain(pos: list[int], source: list[int], k: int, gap_cost: float) -> list[tuple[int, int, int, int]]:
    """Chains of matching seeds (first and last word position on both sides), best first. Positions are of k-mers."""
    return [(pos[c[0]], pos[c[-1]] + k, source[c[0]], source[c[-1]] + k) for c in chained(pos, source, k, gap_cost)]


def chained(pos: list[int], source: list[int], k: int, gap_cost: float) -> list[list[int]]:
    """The same chains as lists of their seeds' numbers."""
    rising = all(x < y for x, y in pairwise(pos)) and all(x < y for x, y in pairwise(source))  # the best of all before, no tree
    top: tuple[float, int] = (-np.inf, -1)
    order = range(len(pos)) if rising else sorted(range(len(pos)), key=lambda i: (pos[i], -source[i]))
    place = {} if rising else {s: i + 1 for i, s in enumerate(sorted(set(source)))}
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(place) + 1)  # prefix maxima of score + cost * (pos + source)
    score, before = [0.0] * len(pos), [-1] * len(pos)
    waiting: list[int] = []
    last = None
    for i in [*order, None]:
        if i is None or pos[i] != last:  # seeds at one position can't precede each other
            for j in waiting:
                entry = (score[j] + gap_cost * (pos[j] + source[j]), j)
                top, t = max(top, entry), len(tree) if rising else place[source[j]]
                while t < len(tree):
                    if tree[t] < entry:
                        tree[t] = entry
                    t += t & -t
            waiting = []
        if i is None:
            break
        last = pos[i]
        t, best = (0, top) if rising else (place[source[i]] - 1, (-np.inf, -1))
        while t:
            best = max(best, tree[t])
            t -= t & -t
        score[i] = float(k)
        if best[1] >= 0:
            j = best[1]
            worth = min(k, pos[i] - pos[j], source[i] - source[j])
            gain = score[j] + worth - gap_cost * ((pos[i] - pos[j]) + (source[i] - source[j]))
            if gain > score[i]:
                score[i], before[i] = gain, j
        waiting.append(i)
    used, out = [False] * len(pos), []
    for i in sorted(range(len(pos)), key=lambda i: -score[i]):
        if used[i]:
            continue
        members = [i]
        used[i] = True
        while before[members[-1]] >= 0 and not used[before[members[-1]]]:
            members.append(before[members[-1]])
            used[members[-1]] = True
        out.append(members[::-1])
    return out


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel steps (Hyyrö)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def common_words(a: list, b: list) -> list[tuple[int, int]]:
    """Places on both sides of the words of a longest common subsequence."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            out.append((i, j))
    return out[::-1]


def _reach(a: list, b: list, i: int, j: int, step: int, drop: int) -> int:
    """How many words beyond (i, j) match well: +1 a match, -2 a mismatch, until the sum falls ``drop`` below its best."""
    total = best = reach = n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and best - total < drop:
        n += 1
        total += 1 if a[i] == b[j] else -2
        if total > best:
            best, reach = total, n
        i, j = i + step, j + step
    return reach


def align(a: list, b: list, start: int, end: int, from_: int, to: int, drop: int = 8) -> tuple[int, int, int, int, float]:
    """Extended span on both sides, and the share of words in common."""
    left, right = _reach(a, b, start - 1, from_ - 1, -1, drop), _reach(a, b, end, to, 1, drop)
    start, from_, end, to = start - left, from_ - left, end + right, to + right
    x, y = a[start:end], b[from_:to]
    return start, end, from_, to, 1.0 if x == y else common_length(x, y) / max(len(x), len(y), 1)


def runs_of(a: list, b: list, seeds: list[tuple[int, int]], k: int, drop: int = 8) -> list[list[int]]:
    """[place, source place, length] of the runs of equal words along a chain of seeds: in it, between them and beyond its ends."""
    runs: list[list[int]] = []

    def add(i: int, j: int, n: int = 1) -> None:
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += n
        else:
            runs.append([i, j, n])

    def diagonal(i: int, j: int, n: int) -> None:
        for t in range(n):
            if a[i + t] == b[j + t]:
                add(i + t, j + t)

    i, j = seeds[0]
    left = _reach(a, b, i - 1, j - 1, -1, drop)
    diagonal(i - left, j - left, left)
    for at, from_ in seeds:
        over = max(0, i - at, j - from_)  # a seed can lie over the one before
        at, from_ = at + over, from_ + over
        x, y = a[i:at], b[j:from_]
        if len(x) * len(y) > MOST_CELLS:
            left, right = _reach(x, y, 0, 0, 1, drop), _reach(x, y, len(x) - 1, len(y) - 1, -1, drop)
            diagonal(i, j, left)
            right = min(right, len(x) - left, len(y) - left)
            diagonal(at - right, from_ - right, right)
        else:
            for p, q in common_words(x, y):
                add(i + p, j + q)
        if k > over:
            add(at, from_, k - over)
        i, j = at + max(k - over, 0), from_ + max(k - over, 0)
    diagonal(i, j, _reach(a, b, i, j, 1, drop))
    return runs


def parts(runs: list[list[int]], min_words: int, min_identity: float, k: int) -> list[tuple[int, int, int, int, float]]:
    """The longest stretch of runs that is long and alike enough, then the longest before and after it, and so on.

    Shorter runs than a seed at the ends of a stretch are left out if foreign words outweigh them.
    """
    if not runs:
        return []
    at, from_, n = np.array(runs, np.int64).T
    end, to, total = at + n, from_ + n, np.concatenate([[0], np.cumsum(n)])

    def alike(i: int, j) -> np.ndarray:
        length = end[j] - at[i]
        return (length >= min_words) & (total[j + 1] - total[i] >= min_identity * np.maximum(length, to[j] - from_[i]) - 1e-9)

    out, waiting = [], [(0, len(runs) - 1)]
    while waiting:
        low, high = waiting.pop()
        best, found = 0, (0, 0)
        for i in range(low, high + 1):
            if end[high] - at[i] < max(min_words, best + 1):
                break
            fits = np.flatnonzero(alike(i, np.arange(i, high + 1)))
            if len(fits) and end[j := i + int(fits[-1])] - at[i] > best:
                best, found = int(end[j] - at[i]), (i, j)
        if not best:
            continue
        i, j = found
        while n[j] < min(k, 2 * max(at[j] - end[j - 1], from_[j] - to[j - 1]) + 1) and j > i and alike(i, j - 1):
            j -= 1
        while n[i] < min(k, 2 * max(at[i + 1] - end[i], from_[i + 1] - to[i]) + 1 if i < j else 0) and i < j and alike(i + 1, j):
            i += 1
        out.append((int(at[i]), int(end[j]), int(from_[i]), int(to[j]), float((total[j + 1] - total[i]) / max(end[j] - at[i], to[j] - from_[i]))))
        waiting += [(low, i - 1), (j + 1, high)]
    return sorted(out)


def covering(found: list[tuple]) -> list[tuple]:
    """Of passages (start, end, source start, source end, identity) those that are needed to cover every word that any of them covers.

    In lines that repeat, a passage fits its source at each turn of the line; no more than two of these lie over a word here.
    """
    out: list[tuple] = []
    for one in sorted(found, key=lambda f: (f[0], -f[1], -f[4])):
        if out and one[1] <= out[-1][1]:
            continue
        if len(out) > 1 and one[0] <= out[-2][1]:
            out.pop()
        out.append(one)
    return out


def stretches_of(at: np.ndarray, codes: np.ndarray, source: np.ndarray, place: np.ndarray, k: int, window: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the first seed, hash, words to the last seed's position) of stretches of shared seeds that lead to several places.

    ``at`` is sorted; ``source`` and ``place`` are where each seed first occurs. A stretch begins at a seed and has all seeds of
    the next ``min_words`` - ``window`` words, so that a passage of ``min_words`` holds one. Where all its seeds lead to one
    place of one source, that source is seen without it. Documents after each other are one call, if their places lie far apart.
    """
    last = np.searchsorted(at, at + min_words - window - k, "right") - 1
    gaps = np.append(0, np.cumsum(np.diff(at) > window))  # a wider gap has a seed that no other document has
    changes = np.append(0, np.cumsum((np.diff(source) != 0) | (np.diff(place - at) != 0)))
    first = np.flatnonzero((at[last] + k - at >= min_words - 2 * window) & (gaps[last] == gaps) & (changes[last] > changes)) if len(at) else last
    last = last[first]
    spans = zip(first.tolist(), (last + 1).tolist(), strict=True)
    names = [xxhash.xxh3_64_intdigest(codes[i:j].tobytes() + (at[i:j] - at[i]).tobytes()) - (1 << 63) for i, j in spans]
    return first, np.array(names, np.int64), at[last] - at[first]


def pairs_of(at: np.ndarray, codes: np.ndarray, source: np.ndarray, place: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the first, number of the second, hash) of two seeds at most ``span`` words apart that no first occurrences hold so.

    ``at`` is sorted; ``source`` and ``place`` are where each seed first occurs. Whether two seeds are such a pair depends on
    that, not on the document, so that all documents that hold both in this order have the pair. Documents after each other
    are one call, if their places lie more than ``span`` apart.
    """
    firsts, seconds, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(at))
    for step in range(1, len(at)):
        near = near[: np.searchsorted(near, len(at) - step)]
        near = near[at[near + step] - at[near] <= span]  # the seeds that have one ``step`` places on; the others have none farther on either
        if not len(near):
            break
        other = near + step
        gap, ahead = at[other] - at[near], place[other] - place[near]
        fits = (gap >= k) & (codes[other] != codes[near]) & ~((source[other] == source[near]) & (ahead >= k) & (ahead <= span))
        firsts.append(near[fits])
        seconds.append(other[fits])
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    number = np.unique(codes, return_inverse=True)[1]
    for turn in range(2):  # in lines that repeat, a seed goes with the nearest of equal ones only, on both sides; the nearest come first
        one, other = (i, j) if turn == 0 else (j, i)
        nearest = np.sort(np.unique(one * len(at) + number[other], return_index=True)[1])
        i, j = i[nearest], j[nearest]
    return i, j, mix(mix(codes.view(np.uint64)[i]) * _GOLD + codes.view(np.uint64)[j]).view(np.int64)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, min_identity: float = 0.8, k: int = 5, window: int = 10,
    gap_cost: float = 0.05,
) -> DataFrame:
    """doc_id, start_word, end_word, source_doc_id, source_start, source_end, identity, passage_hash of passages that an earlier document has.

    Words (lower-cased A-Z) are numbered from 0, ends are exclusive. A run of k + window - 1 equal words has a seed in
    common for certain. A passage has ``min_words`` words or more, and ``min_identity`` of them in common with its source.
    Found are passages of which two seeds in order, or a stretch of them, first occur in the source. One whose stretches and pairs
    of seeds all occur earlier elsewhere is missed, and one so much edited that it shares no two seeds (the README has the recall).
    So are words at an end of an exact passage, fewer than the k + window - 1 that hold a seed for certain, which the first owner of
    the rest lacks and a later document has.

    The source is the document with the smaller id. Passages of a document can overlap if they have several sources. Where a
    document's passages lie over each other in one piece of a source, those are returned that cover all their words.
    Null ids, null and short texts have none. Rows that share an id aren't compared with each other; each is with others.
    Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), *seeds_in(batch.column("text"), min_words, k, window)], ["doc_id", "at", "codes"])

    packed = docs.mapInArrow(seed, f"doc_id {kind}, at array<int>, codes array<bigint>")
    # a place, document and position, as one number where ids and texts are small enough: half the bytes to sort and shuffle
    least, most, longest = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    small = kind in ("bigint", "int") and least is not None and least >= 0 and most < 1 << 38 and longest < 1 << 25
    place = F.shiftleft(F.col("doc_id").cast("bigint"), 24).bitwiseOR(F.col("at").cast("bigint")) if small else F.struct("doc_id", "at")
    doc_of = (lambda p: F.shiftright(p, 24).cast(kind)) if small else (lambda p: p["doc_id"])
    at_of = (lambda p: p.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")) if small else (lambda p: p["at"])
    seeds = written(packed.select("doc_id", F.inline(F.arrays_zip("codes", "at")).alias("code", "at")).select("code", place.alias("place")))
    owners = seeds.groupBy("code").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    owners = cut(owners.where(doc_of(F.col("first")) < doc_of(F.col("last"))).select("code", "first", "n"))
    matches = salted_join(seeds, owners.select("code", "first"), "code", hot_keys(owners, "code", "n")).select(
        "code", doc_of(F.col("place")).alias("doc_id"), at_of(F.col("place")).alias("at"), F.lit(0).alias("more"),
        doc_of(F.col("first")).alias("source_id"), at_of(F.col("first")).alias("source_at"), F.lit(0).alias("source_more"),
    )
    chain_type = "struct<source_id: {0}, lo: int, hi: int, source_lo: int, source_hi: int, at: array<int>, source_at: array<int>>".format(kind)
    key_type = "struct<code: bigint, at: int, more: int>"
    i32, i32s = pa.int32(), pa.list_(pa.int32())

    def link(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        """A document's chains, and at first its stretches."""
        for batch in few_items(batches, "at"):
            ids, flat = batch.column("doc_id"), {c: batch.column(c).flatten() for c in LISTS}
            sizes = pa.compute.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
            names = pa.concat_arrays([ids, flat.pop("source_id")]).dictionary_encode()
            own, source = np.split(names.indices.to_numpy(), [len(ids)])
            doc, (at, code, more, source_at, source_more) = np.repeat(np.arange(len(ids)), sizes), (x.to_numpy() for x in flat.values())
            order = np.lexsort((more, code, at, doc))
            doc, source, at, code, more, source_at, source_more = (x[order] for x in (doc, source, at, code, more, source_at, source_more))
            # the pairs of places that a document and another have in common, after each other
            row = np.flatnonzero(source != own[doc])
            row, right = np.concatenate([row, row if again else row[:0]]), np.arange(len(row) * (1 + again)) >= len(row)
            pos, there = at[row] + more[row] * right, source_at[row] + source_more[row] * right
            order = np.lexsort((there, pos, source[row], doc[row]))
            row, pos, there = row[order], pos[order], there[order]
            edge = lambda *columns: np.append(np.ones(min(len(row), 1), bool), reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)))
            groups = np.flatnonzero(edge(doc[row], source[row]))
            seen = np.minimum.reduceat(row, groups) if len(groups) else groups  # sources in the order in which the document leads to them
            distinct = edge(doc[row], source[row], pos, there)
            ends = np.append(np.cumsum(distinct)[groups] - 1, distinct.sum())
            pos, there = pos[distinct].tolist(), there[distinct].tolist()
            chains, chained_docs = [], []
            for g in np.argsort(seen):
                i, j = ends[g], ends[g + 1]
                if j - i == 1 and not lone:
                    continue
                s, d = int(source[seen[g]]), int(doc[seen[g]])
                for members in chained(pos[i:j], there[i:j], k, gap_cost):
                    if len(members) > 1 or lone:
                        places, sources = [pos[i + m] for m in members], [there[i + m] for m in members]
                        chains.append((s, *_grid(places[0], places[-1] + k), *_grid(sources[0], sources[-1] + k), places, sources))
                        chained_docs.append(d)
            first, keys, reach = (np.zeros(0, np.int64),) * 3 if again else stretches_of(at + (doc << 40), code, source, source_at + (doc << 40), k, window, min_words)
            columns = list(zip(*chains, strict=True)) or [()] * 7
            parts_ = [names.dictionary.take(pa.array(columns[0], i32)), *(pa.array(c, t) for c, t in zip(columns[1:], [i32] * 4 + [i32s] * 2, strict=True))]
            chains = pa.StructArray.from_arrays(parts_, ["source_id", "lo", "hi", "source_lo", "source_hi", "at", "source_at"])
            keys = pa.StructArray.from_arrays([pa.array(keys), pa.array(at[first], i32), pa.array(reach, i32)], ["code", "at", "more"])
            listed = [
                pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(ids) + 1)), i32), x) for of, x in ((np.array(chained_docs, np.int64), chains), (doc[first], keys))
            ]
            some = np.isin(np.arange(len(ids)), np.append(doc[first], np.array(chained_docs, np.int64)))
            yield pa.record_batch([ids, *listed], ["doc_id", "chains", "keys"]).filter(pa.array(some))

    lone = k + 2 * (k + window) >= min_words  # one seed and what is around it can be a passage
    LISTS = ["at", "code", "more", "source_id", "source_at", "source_more"]
    schema = f"doc_id {kind}, chains array<{chain_type}>, keys array<{key_type}>"
    gathered = lambda m, names: m.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in names))
    linked = lambda lists, again: written(lists.mapInArrow(partial(link, again=again), schema))

    def led(keys: DataFrame, asking: DataFrame) -> DataFrame:
        """Chains that lead from keys that ask to the first occurrence of their key."""
        last = F.max(F.when(F.col("asks"), F.col("doc_id")))
        first = keys.groupBy("code").agg(F.min(F.struct("doc_id", "at", "more")).alias("first"), last.alias("last"), F.count(F.lit(1)).alias("n")).where("first.doc_id < last")
        first = cut(first.select("code", F.col("first.doc_id").alias("source_id"), F.col("first.at").alias("source_at"), F.col("first.more").alias("source_more"), "n"))
        return linked(gathered(salted_join(asking, first.drop("n"), "code", hot_keys(first, "code", "n")), LISTS), True)

    shared = written(gathered(matches, LISTS))
    once = linked(shared, False)
    left = once.select("doc_id", F.inline("keys"))
    rounds = [once, led(left.withColumn("asks", F.lit(True)), left)]
    PIECE = ["source_id", "source_lo", "source_hi", "source_words", "doc_id", "chains"]
    cut_type = f"source_id {kind}, source_lo int, source_hi int, source_words binary, doc_id {kind}, chains array<struct<lo: int, words: binary, at: array<int>, source_at: array<int>>>"

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece that others ask for, and of a document's own chains by the piece that they ask for."""
        for batch in slices(batches, "text"):
            t = batch.schema.field("doc_id").type
            types = [t, i32, i32, pa.binary(), t, pa.list_(pa.struct([("lo", i32), ("words", pa.binary()), ("at", i32s), ("source_at", i32s)]))]
            for part in few_rows([batch], 64):
                rows = []
                for d, text, pieces, own in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "pieces", "chains")), strict=True):
                    words, to = words_of(text), {}
                    rows += [(d, p["lo"], p["hi"], b" ".join(words[p["lo"] : p["hi"]]), None, None) for p in pieces or []]
                    for c in own or []:
                        if c["at"][-1] + k <= len(words):  # else it is of another row with this id
                            one = {"lo": c["lo"], "words": b" ".join(words[c["lo"] : c["hi"]]), "at": c["at"], "source_at": c["source_at"]}
                            to.setdefault((c["source_id"], c["source_lo"], c["source_hi"]), []).append(one)
                    rows += [(*place, None, d, of) for place, of in to.items()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], PIECE)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 64):
            rows, t = [], batch.schema.field("doc_id").type
            for d, s, source_lo, b, own in zip(*(batch.column(c).to_pylist() for c in FULL), strict=True):
                b, words, alike = b.split(b" "), {}, []
                for c in own:
                    lo, a, at, source_at = c["lo"], c["words"].split(b" "), [i - c["lo"] for i in c["at"]], [i - source_lo for i in c["source_at"]]
                    if any(a[i : i + k] != b[j : j + k] for i, j in zip(at, source_at, strict=True)):
                        continue  # the piece of another row with this id
                    whole = align(a, b, at[0], at[-1] + k, source_at[0], source_at[-1] + k)
                    if whole[1] - whole[0] < min_words:
                        continue
                    good = [whole] if whole[4] >= min_identity else parts(runs_of(a, b, list(zip(at, source_at, strict=True)), k), min_words, min_identity, k)
                    words[lo, len(a)] = a
                    alike += [(start + lo, end + lo, from_ + source_lo, to + source_lo, same, (lo, len(a))) for start, end, from_, to, same in good]
                for start, end, from_, to, same, of in covering(alike):
                    rows.append((d, start, end, s, from_, to, same, _name(words[of][start - of[0] : end - of[0]])))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, [t, pa.int32(), pa.int32(), t, pa.int32(), pa.int32(), pa.float64(), pa.int64()], strict=True)], OUT)

    FULL = ["doc_id", "source_id", "source_lo", "source_words", "chains"]
    OUT = ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "identity", "passage_hash"]
    found_type = f"doc_id {kind}, start_word int, end_word int, source_doc_id {kind}, source_start int, source_end int, identity double, passage_hash bigint"

    def settled(rounds: list[DataFrame]) -> DataFrame:
        """Passages along the chains. The words that the alignments need are cut from the texts once: the grid makes the wanted pieces
        few. A document's chains that lead to one piece of a source are a row, so that a phrase that is often in both is one row."""
        chains = reduce(DataFrame.unionByName, rounds).where("size(chains) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("chains")).alias("chains"))
        wishes = F.array_distinct(F.transform("chains", lambda c: F.struct(c["source_id"].alias("doc_id"), c["source_lo"].alias("lo"), c["source_hi"].alias("hi"))))
        asked = chains.select(F.inline(wishes))
        wanted = written(asked.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("pieces")).join(chains, "doc_id", "full"))
        # rows that share an id have a piece each; the alignment tells which of them holds the passage
        pieces = written(likely_among(docs, "doc_id", wanted).join(wanted, "doc_id").mapInArrow(carve, cut_type).distinct())
        place = ["source_id", "source_lo", "source_hi"]
        full = pieces.where("doc_id is not null").drop("source_words").join(pieces.where("doc_id is null").select(*place, "source_words"), place)
        return written(full.select(*FULL).mapInArrow(settle, found_type))

    def unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists as they came, sorted by place, and each seed's state: 2 if no passage lies over it, 1 if such a seed is near, else 0."""
        for batch in few_items(batches, "at"):
            sizes = pa.compute.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
            flat, ends = [batch.column(c).flatten() for c in SEED[:-1]], np.append(0, np.cumsum(sizes))
            order = np.lexsort((flat[0].to_numpy(), np.repeat(np.arange(len(sizes)), sizes)))
            places, states = flat[0].to_numpy()[order], []
            for n, spans in enumerate(batch.column("spans").to_pylist()):
                at = places[ends[n] : ends[n + 1]]
                open_ = np.ones(len(at), bool)
                for s in spans or []:
                    open_[np.searchsorted(at, s["start_word"]) : np.searchsorted(at, s["end_word"] - k, "right")] = False
                after, before = np.append(at[open_], 1 << 40), np.append(-(1 << 40), at[open_])
                near = (after[np.searchsorted(at[open_], at)] - at <= min_words) | (at - before[np.searchsorted(at[open_], at, "right")] <= min_words)
                states.append(np.where(open_, 2, near.astype(np.int32)))
            flat = [c.take(pa.array(order)) for c in flat] + [pa.array(np.concatenate([np.zeros(0, np.int32), *states]), i32)]
            yield pa.record_batch([batch.column("doc_id"), *(pa.ListArray.from_arrays(pa.array(ends, i32), c) for c in flat)], ["doc_id", *SEED])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(code, doc_id, at, more, asks) of a document's pairs; one asks if no passage lies over one of its seeds."""
        for batch in few_items(batches, "at", 20_000):
            sizes = pa.compute.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
            flat, doc = [batch.column(c).flatten() for c in SEED], np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat[0].to_numpy(), doc))
            at, codes, source, place, state = (x.to_numpy()[order] for x in (*flat[:2], flat[2].dictionary_encode().indices, *flat[3:]))
            doc = doc[order]
            i, j, code = pairs_of(at + (doc << 40), codes, source, place.astype(np.int64), k, min_words)
            columns = [pa.array(code), batch.column("doc_id").take(pa.array(doc[i])), pa.array(at[i], i32), pa.array(at[j] - at[i], i32), pa.array(np.maximum(state[i], state[j]) == 2, pa.bool_())]
            yield pa.record_batch(columns, ["code", "doc_id", "at", "more", "asks"])

    SEED = ["at", "code", "source_id", "source_at", "state"]
    passages = settled(rounds)
    over = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    lists = f"doc_id {kind}, at array<int>, code array<bigint>, source_id array<{kind}>, source_at array<int>, state array<int>"
    marked = written(shared.join(over, "doc_id", "left").select("doc_id", *SEED[:-1], "spans").mapInArrow(unsettled, lists))
    marked = marked.select("doc_id", F.inline(F.arrays_zip(*SEED)).alias(*SEED))
    asked = cut(marked.where("state > 0").groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    pairs = gathered(salted_join(marked, asked.drop("n"), "code", hot_keys(asked, "code", "n")), SEED)
    pairs = written(pairs.mapInArrow(pair, f"code bigint, doc_id {kind}, at int, more int, asks boolean"))
    passages = passages.unionByName(settled([led(pairs, pairs.where("asks").drop("asks"))]))
    return passages.groupBy(*(c for c in OUT if c not in ("identity", "passage_hash"))).agg(F.max("identity").alias("identity"), F.max("passage_hash").alias("passage_hash"))


def _name(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _grid(start: int, end: int) -> tuple[int, int]:
    return max(0, start - MARGIN) // GRID * GRID, -(-(end + MARGIN) // GRID) * GRID


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the passages: their words go, with the white space between them; the rest stays as it is.

    A passage is cut from the rows with its id that hold its words at its place: of rows that share an id, others stay as
    they are. A text of which nothing but white space is left goes as a whole. ``chars_col`` is set to the new length where
    a text changes. Rows without id and null and empty texts stay. All columns are kept, in their order.
    """
    at, spans = fresh_name(docs, "id"), fresh_name(docs, "spans")
    found = passages.groupBy(F.col("doc_id").alias(at)).agg(F.collect_set(F.struct("start_word", "end_word", "passage_hash")).alias(spans))
    joined = docs.join(found, docs[id_col] == found[at], "left").drop(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, old = batch.column(text_col).to_pylist(), batch.column(spans).to_pylist()
            new = [t if not s or t is None else without(t, _held(t, s)) for t, s in zip(texts, old, strict=True)]
            names = [n for n in batch.schema.names if n != spans]
            columns = {n: batch.column(n) for n in names}
            columns[text_col] = pa.array(new, pa.string())
            changed = [a is not b for a, b in zip(texts, new, strict=True)]
            if chars_col in columns:
                columns[chars_col] = pa.array([len(t) if c else n for t, c, n in zip(new, changed, columns[chars_col].to_pylist(), strict=True)], columns[chars_col].type)
            gone = [c and not _WORD.search(t) for t, c in zip(new, changed, strict=True)]
            yield pa.record_batch([columns[n] for n in names], names).filter(pa.array([not g for g in gone], pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def _held(text: str, spans: list[dict]) -> list[tuple[int, int]]:
    """Those of the spans whose words the text has."""
    words = words_of(text)
    return [(s["start_word"], s["end_word"]) for s in spans if _name(words[s["start_word"] : s["end_word"]]) == s["passage_hash"]]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    done = 0
    for start, end in sorted(spans):
        start, end = max(start, done), min(end, len(places))
        if start >= end:
            continue
        out.append(text[at : places[start][0]])
        at, done = places[end][0] if end < len(places) else len(text), end
    return "".join([*out, text[at:]])
