"""Near-duplicate classes by BagMinHash signatures over multisets of word shingles.

Signature. A shingle's count is its weight. Over the axis of weights and time, each shingle has a Poisson process whose
points each fall into one of m registers; a text with count w takes the points at weight w or below, and a register
keeps the earliest. Two texts share a register's point with a chance equal to their weighted Jaccard similarity,
sum of min / sum of max. Weights are discretised: the axis is cut at 1, 2, 4, 8, ..., each piece a process of its own
rate (the pieces of Ertl 2018). A piece that w cuts isn't split further as in the paper's tree: its points draw their
weight and count where that is at most w. Which points count is the same; at most as many again are drawn as the piece
has below w. Points come in the order of time and stop where all registers are full, so a text costs one draw a shingle
and about m log m more.

Join. Equal texts are one node, named by their digest, and only buckets of several nodes count. There are two passes.
(1) Each bucket is dealt at random into parts of bounded size; in its part each node is paired with the few earlier ones
that agree with it on most registers: so many pairs a node and bucket, however large the bucket. The pairs are verified on
whole texts, and components of the links are taken. (2) Where a bucket then holds several classes, all nodes outside its
largest class are set against all nodes of other classes, in blocks that have the texts, so that only links leave them. So each pair of a bucket is compared, or known to
be of one class. In both passes a byte of each register stands for the text first: it drops pairs whose estimate is over
4.5 deviations too low.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, likely_among, salted_join, slices, written
from .components import components
from .lm_scoring import words_of

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator (public domain)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(words: list, n: int) -> Counter:
    """Counts of the n-word shingles; fewer words make one shingle, none make none."""
    if not words:
        return Counter()
    return Counter(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else Counter([tuple(words)])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets; two empty ones have none."""
    shared = sum(min(k, b[x]) for x, k in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class Signer:
    def __init__(self, n_words: int = 5, bands: int = 32, rows: int = 5, most_words: int = 100_000):
        self.n_words, self.bands, self.rows, self.m, self.most_words = n_words, bands, rows, bands * rows, most_words
        self.known: dict[bytes, int] = {}

    def _elements(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle hash, count), by text."""
        known = self.known
        if len(known) > self.most_words:
            known.clear()
        rows = [words_of(t) for t in texts]
        for row in rows:
            for w in row:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((known[w] for row in rows for w in row), np.uint64, int(sizes.sum()))
        n = self.n_words
        doc, code = [], []
        if len(flat) >= n:
            full = np.full(len(flat) - n + 1, np.uint64(n))
            for i in range(n):
                full = mix(full * _GOLD + flat[i : len(flat) - n + 1 + i])
            owner = np.repeat(np.arange(len(rows)), sizes)
            whole = owner[: len(full)] == owner[n - 1 :]
            doc.append(owner[: len(full)][whole])
            code.append(full[whole])
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
            h = np.array([sizes[i]], np.uint64)
            for w in flat[starts[i] : starts[i] + sizes[i]]:
                h = mix(h * _GOLD + w)
            doc.append(np.array([i]))
            code.append(h)
        if not doc:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc, code = np.concatenate(doc), np.concatenate(code)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        at = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (code != np.roll(code, 1)))
        return doc[at], code[at], np.diff(np.append(at, len(doc)))

    def registers(self, doc: np.ndarray, code: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """n x m earliest times; infinite for texts without shingles."""
        m = self.m
        out = np.full(n * m, np.inf)
        weight = np.bincount(doc, count, n)
        limit = np.where(weight > 0, (np.log(m) + 4) / np.maximum(weight, 1), 0)
        left = weight > 0
        while left.any():
            chosen = left[doc]
            d, h, w = doc[chosen], code[chosen], count[chosen]
            # the pieces (0, 1], (1, 2], (2, 4], ... that begin below the count
            pieces = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64), 0) + 1
            which = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            d, h, w = np.repeat(d, pieces), np.repeat(h, pieces), np.repeat(w, pieces)
            width = np.where(which == 0, 1, 1 << np.maximum(which - 1, 0))
            low = np.where(which == 0, 0, width)
            state = mix(h + (which.astype(np.uint64) + np.uint64(1)) * _GOLD)
            time, rate, most = np.zeros(len(d)), (m * width).astype(float), limit[d]
            while len(d):
                state = state + _GOLD
                first = mix(state)
                time = time - np.log(((first >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
                alive = time <= most
                d, w, low, width, state, time, rate, most = (x[alive] for x in (d, w, low, width, state, time, rate, most))
                second = mix(state ^ _B)
                level = low + 1 + ((second >> np.uint64(32)).astype(np.int64) & (width - 1))
                counted = level <= w
                register = ((second & np.uint64(0xFFFFFFFF)).astype(np.int64) * m) >> 32
                np.minimum.at(out, d[counted] * m + register[counted], time[counted])
            full = np.isfinite(out.reshape(n, m)).all(1)
            left &= ~full
            limit = limit * 2
        return out.reshape(n, m)

    def sign(self, texts: list[str | None]) -> tuple[list, np.ndarray, list[bytes]]:
        """Of each text the band hashes (none without words), the number of shingles, and a byte of each register."""
        doc, code, count = self._elements(texts)
        registers = self.registers(doc, code, count, len(texts))
        sizes = np.bincount(doc, count, len(texts)).astype(np.int64)
        value = registers.view(np.uint64).reshape(len(texts), self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * _GOLD + np.zeros((len(texts), 1), np.uint64)
        for i in range(self.rows):
            h = mix(h * _GOLD + value[:, :, i])
        sketch = [row.tobytes() for row in (registers.view(np.uint64) & np.uint64(0xFF)).astype(np.uint8)]
        return [row if size else None for row, size in zip(h.view(np.int64), sizes.tolist(), strict=True)], sizes, sketch


def _signatures(docs: DataFrame, n_words: int, bands: int, rows: int) -> DataFrame:
    """node, size, bands, sketch of docs (text); without bands where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n_words, bands, rows)
        for batch in slices(batches, "text", 2 << 20):
            h, sizes, sketch = signer.sign(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(h, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["node", "size", "bands", "sketch"])

    return docs.select("node", "text").mapInArrow(run, "node binary, size bigint, bands array<bigint>, sketch binary")


def _agreement(sketches: np.ndarray, others: np.ndarray, sizes: np.ndarray, other_sizes: np.ndarray, threshold: float, step: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Of ``step`` rows at a time, the share of registers on which they agree with each of the others; -1 where the sizes are too unlike."""
    for i in range(0, len(sketches), step):
        share = (sketches[i : i + step, None, :] == others[None]).mean(2)
        a, b = sizes[i : i + step, None], other_sizes[None]
        share[np.minimum(a, b) < threshold * np.maximum(a, b)] = -1
        yield i, share


def _table_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    n = table.num_rows
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    return sketches, table.column("size").to_numpy(), table.column("node").combine_chunks()


def _groups(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the rows of each distinct combination."""
    order = np.lexsort(columns[::-1])
    changed = np.zeros(len(order), bool)
    for c in columns:
        changed[1:] |= c[order][1:] != c[order][:-1]
    return iter(np.split(order, np.flatnonzero(changed))) if len(order) else iter(())


def _nearest(threshold: float, least: float, partners: int) -> Callable[[pa.Table], pa.Table]:
    """The first pass in some parts of buckets: each node with the earlier ones that it agrees with most, the nearest of as good ones."""

    def run(table: pa.Table) -> pa.Table:
        sketches, sizes, nodes = _table_of(table)
        a, b = [], []
        for at in _groups(table.column("bucket").to_numpy(), table.column("part").to_numpy()):
            if len(at) < 2:
                continue
            for i, share in _agreement(sketches[at], sketches[at], sizes[at], sizes[at], threshold):
                x, y = np.arange(i, i + len(share))[:, None], np.arange(len(at))[None]
                share = np.where((y < x) & (share >= least), share + y * 1e-9, -1.0)
                best = np.argpartition(-share, min(partners, len(at)) - 1, 1)[:, :partners]
                r, c = np.nonzero(np.take_along_axis(share, best, 1) >= 0)
                a.append(at[best[r, c]])
                b.append(at[r + i])
        return _pairs(nodes, a, b)

    return run


def _crossing(threshold: float, least: float, n_words: int) -> Callable[[pa.Table], pa.Table]:
    """The second pass in some blocks: nodes outside the bucket's largest class (``minor``) with all of other classes.

    A pair is compared in the first band that it shares, by its shingles' hashes, and one link of two classes is enough.
    """

    def run(table: pa.Table) -> pa.Table:
        sketches, sizes, nodes = _table_of(table)
        minor, label = table.column("minor").to_numpy(), table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        bands = table.column("bands").combine_chunks().values.to_numpy().reshape(table.num_rows, -1)
        bucket, text = table.column("bucket").to_numpy(), table.column("text").combine_chunks()
        signer, a, b, known = Signer(n_words), [], [], set()
        for at in _groups(bucket, table.column("q").to_numpy(), table.column("p").to_numpy()):
            x, y = at[minor[at]], at[~minor[at]]
            if not len(x) or not len(y):
                continue
            band, starts, codes, counts = int((bands[x[0]] == bucket[x[0]]).argmax()), {}, {}, {}
            for i, share in _agreement(sketches[x], sketches[y], sizes[x], sizes[y], threshold):
                r, c = np.nonzero((share >= least) & (label[x[i : i + len(share)], None] != label[y][None]))
                first = (bands[x[r + i]] == bands[y[c]]).argmax(1) == band
                r, c = x[r[first] + i], y[c[first]]
                new = [u for u in set(r.tolist()).union(c.tolist()) if u not in codes]
                if new:
                    doc, code, count = signer._elements(text.take(pa.array(new)).to_pylist())
                    edges = np.searchsorted(doc, np.arange(len(new) + 1))
                    for j, u in enumerate(new):
                        codes[u], counts[u] = code[edges[j] : edges[j + 1]], count[edges[j] : edges[j + 1]]
                for u in np.unique(r).tolist():
                    others = c[r == u]
                    flat, weight = np.concatenate([codes[v] for v in others.tolist()]), np.concatenate([counts[v] for v in others.tolist()])
                    place = np.minimum(np.searchsorted(codes[u], flat), len(codes[u]) - 1)
                    common = np.where(codes[u][place] == flat, np.minimum(counts[u][place], weight), 0)
                    owner = np.repeat(np.arange(len(others)), [len(codes[v]) for v in others.tolist()])
                    shared = np.bincount(owner, common, len(others))
                    for v in others[shared >= threshold * (sizes[u] + sizes[others] - shared) - 1e-6].tolist():
                        if (pair := (label[u], label[v])) not in known:
                            known.add(pair)
                            a.append([u])
                            b.append([v])
        return _pairs(nodes, a, b)

    return run


def _pairs(nodes: pa.Array, a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    take = lambda places: nodes.take(pa.array(np.concatenate(places) if places else np.zeros(0, np.int64)))
    return pa.table([take(a), take(b)], ["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in slices(batches, "text_a", 1 << 20):
            kept = []
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b")), strict=True):
                if b != last_id:
                    last_id, last = b, shingles(words_of(y), n_words)
                kept.append(similarity(last, shingles(words_of(x), n_words)) >= threshold)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").repartition(tasks, "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def node_of(text: Column) -> Column:
    """What names a text: its MD5 digest."""
    return F.unhex(F.md5(text.cast("binary")))


def text_classes(
    docs: DataFrame, text_col: str = "text", n_words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, partners: int = 2, part_rows: int = 4096,
    block_rows: int = 1024, cell_rows: int = 20_000, cell_bytes: int = 16 << 20,
) -> tuple[DataFrame, DataFrame]:
    """(node, copies) of all distinct texts, and (node, label) of those that are similar to another; equal labels make a class.

    ``partners``: pairs a node and bucket in the first pass; ``part_rows``, ``block_rows``: nodes in a part (first pass) or
    on each side of a block (second pass) of a bucket; ``cell_rows``, ``cell_bytes``: what a task holds at a time, about. These change the work, not the classes.
    """
    texts = docs.select(node_of(F.col(text_col)).alias("node"), F.col(text_col).alias("text")).where("text is not null")
    one = [F.first(c).alias(c) for c in ("size", "bands", "sketch")]  # copies have the same
    signed = written(_signatures(texts, n_words, bands, rows).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), *one))
    nodes = signed.select("node", "copies")
    # eight bytes of the digest go through the big shuffles; nodes that share them are each other's candidates, no more
    short = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("bigint").alias("short")
    banded = signed.where("bands is not null").select(F.explode("bands").alias("bucket"), short)
    crowded = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = salted_join(banded, crowded, "bucket", hot_keys(crowded, "bucket", "n"))
    involved = cut(members.join(signed.select("node", "size", short), "short").drop("short"))
    ids = cut(involved.select("node").distinct())
    sketches = signed.join(ids, "node", "left_semi").select("node", "sketch")
    wanted = written(likely_among(texts, "node", ids).groupBy("node").agg(F.first("text").alias("text")).join(ids, "node"))
    cells = max(1, -(-involved.count() // cell_rows))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, f: df.repartition(tasks, "cell").groupBy("cell").applyInArrow(f, "a binary, b binary")  # noqa: E731  (few bytes, much work: no merging of partitions)
    least = threshold - 4.5 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5

    # first pass
    parts = involved.join(sketches, "node").withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / part_rows)).cast("int"))
    near = parts.select("bucket", "part", "node", "size", "sketch", F.pmod(F.xxhash64("bucket", "part"), F.lit(cells)).cast("int").alias("cell"))
    links = cut(_verify(dealt(near, _nearest(threshold, least, partners)), wanted, n_words, threshold))
    labels = components(links)

    # second pass
    known = cut(involved.select("bucket", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    classes = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = cut(
        classes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
        .select("bucket", "n", F.col("top.label").alias("major"), F.ceil((F.col("n") - F.col("top.c")) / block_rows).cast("int").alias("qs"), F.ceil(F.col("n") / block_rows).cast("int").alias("ps"))
    )
    rest = salted_join(known, mixed, "bucket", hot_keys(mixed, "bucket", "n")).join(signed.join(ids, "node").select("node", "sketch", "bands"), "node").join(wanted, "node").select(
        "bucket", "node", "size", "sketch", "bands", "text", "label", (F.col("label") != F.col("major")).alias("outside"), "qs", "ps",
        F.pmod(F.xxhash64("node", "bucket"), F.col("qs")).cast("int").alias("q"), F.pmod(F.xxhash64("bucket", "node"), F.col("ps")).cast("int").alias("p"),
    )
    common = ["bucket", "node", "size", "sketch", "bands", "text", "label"]
    rest = cut(rest)
    held = rest.agg(F.coalesce(F.sum((F.octet_length("text") + 500) * (F.col("qs") + F.when(F.col("outside"), F.col("ps")).otherwise(0))), F.lit(0))).first()[0]
    cells = max(1, -(-held // cell_bytes))
    ones = rest.where("outside").select(*common, F.lit(True).alias("minor"), "q", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"))
    all_ = rest.select(*common, F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "p")
    blocks = ones.unionByName(all_).withColumn("cell", F.pmod(F.xxhash64("bucket", "q", "p"), F.lit(cells)).cast("int"))
    further = cut(_verify(dealt(blocks, _crossing(threshold, least, n_words)), wanted, n_words, threshold))
    if not further.isEmpty():
        labels = components(links.unionByName(further))
    return nodes, labels


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5,
) -> DataFrame:
    """doc_id, class_id of every document: class_id is the smallest id of the documents that chains of similarity join.

    Texts are similar if the weighted Jaccard similarity of their multisets of ``n_words``-word shingles (words lower-cased
    A-Z, split at white space) is ``threshold`` or more. A pair at 0.8 shares one of 32 bands of 5 registers with a chance
    of 1 - 3e-6, and passes the sketches with about the same; links are those of whole texts, so no unlike pair is linked.

    Equal texts are one class, empty ones too. A null text is in a class of its own. Texts without words, equal ones
    apart, are like no other; texts of fewer than ``n_words`` words have one shingle. Each row is judged by its own text,
    whether or not others share its id. A row without id gets its text's class, null if only such rows have the class.
    Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    nodes, labels = text_classes(docs, "text", n_words, threshold, bands, rows)
    rows_ = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    least = rows_.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_node = least.join(labels, "node", "left")
    of_label = of_node.where("label is not null").groupBy("label").agg(F.min("least").alias("of_label"), F.count(F.lit(1)).alias("n"))
    in_class = salted_join(of_node.where("label is not null"), of_label, "label", hot_keys(of_label, "label", "n")).select("node", F.col("of_label").alias("class_id"))
    of_node = least.join(in_class, "node", "left").select("node", F.coalesce("class_id", "least").cast(kind).alias("class_id"))
    judged = salted_join(rows_.where("node is not null"), of_node, "node", hot_keys(nodes, "node", "copies")).select("doc_id", "class_id")
    return judged.unionByName(rows_.where("node is null").select("doc_id", F.col("doc_id").alias("class_id")))
