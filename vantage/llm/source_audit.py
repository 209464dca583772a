"""How far sources of a language differ in their words: distances of all pairs, and the terms that tell a source from its language.

Terms are counted inside the tasks that read the texts and summed by language, source and term. A divergence grows with a
term's share in the source and falls with its share in the language. So a term that k others of the same source beat or equal
in source count, in language count and in spelling can't be among the k first: each part of the terms keeps the k-skyband of
each source, skybands are merged, and only what is left is ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of terms: A-Z as small letters, small letters and all bytes beyond ASCII as they are; all others part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HELD = 500_000  # terms a task holds before it hands its counts on
PART = 20_000  # terms of a language that are compared at a time
CELLS = 1 << 20  # numbers a task works on at a time
SALTS = 32
SCALE = (100_000, 10_000)  # one billion in two steps, so that products stay exact in 64 bits up to 9e13 counts


def _terms(texts: pa.Array, i: int) -> list[bytes]:
    raw = texts[i].as_buffer()
    return [] if raw is None else raw.to_pybytes().translate(TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the texts so far, whenever ``HELD`` terms are held and at the end."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        lang, source, texts = (batch.column(c) for c in ("lang", "source", "text"))
        for i in range(batch.num_rows):
            terms = _terms(texts, i)
            n, docs = groups.setdefault((lang[i].as_py(), source[i].as_py()), (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held >= HELD:
                yield from told()
                held = 0
    yield from told()


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, lang_n, counts): terms in ``least_docs`` documents of a language or more; counts are (source, n), a row a source."""
    partial = docs.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    by_source = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_lang = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_lang.where(F.col("docs") >= least_docs).drop("docs")


def scaled_share(n: np.ndarray, total, terms) -> np.ndarray:
    """1 + floor(1,000,000,000 (n + 2) / (total + 2 terms)), exactly, of 64-bit numbers."""
    d, (first, then) = total + 2 * terms, SCALE
    a = (n + 2) * first
    return 1 + a // d * then + a % d * then // d


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def source_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, n_terms, lang_total, sources): a row a language, sources being (source, total) by name. All that occur, with terms or without."""
    occurring = docs.select("lang", "source").distinct()
    counted = terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = occurring.join(counted, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    return sources.join(langs, "lang", "left").select("lang", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), "sources")


def skyband(order: np.ndarray, counts: np.ndarray, wholes: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Positions of the terms that fewer than ``k`` others dominate: a count no lower, a whole no higher, an earlier place in ``order``.

    In the order of falling count, rising whole and place, all that dominate a term stand before it. It is enough to compare
    with those of the skyband: who is dominated by one outside it is dominated by k inside.
    """
    by = np.lexsort((order, wholes, -counts))
    band = np.zeros(0, np.int64)
    for at in range(0, len(by), step):
        block = by[at : at + step]
        over = lambda others, own: (wholes[others][None, :] <= wholes[own][:, None]) & (order[others][None, :] < order[own][:, None])
        beaten = over(band, block).sum(axis=1)
        block, beaten = block[beaten < k], beaten[beaten < k]
        beaten = beaten + np.tril(over(block, block), -1).sum(axis=1)
        band = np.concatenate([band, block[beaten < k]])
    return band


def _band(rows: pa.Table, k: int) -> pa.Table:
    spelled = pc.rank(rows["term"].combine_chunks().cast(pa.binary())).to_numpy()
    return rows.take(skyband(spelled, rows["n"].to_numpy(), rows["lang_n"].to_numpy(), k))


def _compared(k: int) -> Callable:
    """What ``applyInArrow`` runs on a part of a language's terms and the language's row of totals: sums of divergences of the sources
    a < b (by number, as rows without term) and each source's k-skyband of the terms that it has oftener than its language."""

    def run(terms: pa.Table, totals: pa.Table) -> pa.Table:
        lang, n_terms, lang_total, sources = (totals[c][0].as_py() for c in ("lang", "n_terms", "lang_total", "sources"))
        names, width = [s["source"] for s in sources], len(sources)
        total = np.array([s["total"] for s in sources], np.int64)
        sums, bands = np.zeros((width, width), np.int64), []
        step = max(1, CELLS // width)
        for at in range(0, terms.num_rows, step):
            part = terms.slice(at, step).combine_chunks()
            counts = part["counts"].combine_chunks()
            n = np.zeros((part.num_rows, width), np.int64)
            flat = counts.flatten()
            n[pc.list_parent_indices(counts).to_numpy(), pc.index_in(flat.field("source"), pa.array(names, pa.string())).to_numpy()] = flat.field("n").to_numpy()
            p, lang_n = scaled_share(n, total, n_terms), part["lang_n"].to_numpy()
            q = scaled_share(lang_n, lang_total, n_terms)
            for a in range(width):
                sums[a, a + 1 :] += divergence(p[:, a : a + 1], p[:, a + 1 :]).sum(axis=0)
                often = np.flatnonzero((n[:, a] > 0) & (p[:, a] > q))
                if len(often):
                    columns = {"term": part["term"].take(often), "n": n[often, a], "lang_n": lang_n[often], "value": divergence(p[often, a], q[often])}
                    bands.append((a, _band(pa.table(columns), k)))
        a, b = np.triu_indices(width, 1)
        pairs = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "term": pa.nulls(len(a), pa.string()), "n": pa.nulls(len(a), pa.int64()), "lang_n": pa.nulls(len(a), pa.int64()), "value": sums[a, b]})
        found = [pairs] + [pa.table({"a": pa.array([a] * len(t), pa.int32()), "b": pa.nulls(len(t), pa.int32()), "term": t["term"], "n": t["n"], "lang_n": t["lang_n"], "value": t["value"]}) for a, t in bands]
        rows = pa.concat_tables(found)
        return rows.add_column(0, "lang", pa.array([lang] * len(rows), pa.string()))

    return run


def compared(terms: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(lang, a, b, term, n, lang_n, value) of every part of ``PART`` terms or so of a language: see ``_compared``."""
    most = totals.agg(F.max("n_terms")).first()[0] or 0
    parts = -(-most // PART)
    dealt = terms.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(max(parts, 1))).cast("int"))
    each = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))))
    held = dealt.select("lang", "_part").distinct()  # a row a part: languages without terms have none
    each = each.join(held, ["lang", "_part"])
    schema = "lang string, a int, b int, term string, n bigint, lang_n bigint, value bigint"
    run = _compared(k)
    return dealt.groupBy("lang", "_part").cogroup(each.groupBy("lang", "_part")).applyInArrow(lambda left, right: run(left, right), schema)


def _merged(k: int) -> Callable:
    """What ``mapInArrow`` runs: the k-skyband of each language and source among the task's rows (lang, a, term, n, lang_n, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            places: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("a").to_pylist(), strict=True)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                rows = table.take(at)
                held[key] = _band(pa.concat_tables([held[key], rows]) if key in held else rows, k)
        for rows in held.values():
            yield from rows.combine_chunks().to_batches()

    return run


def telling_terms(found: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): each source's ``k`` terms of the largest divergence, of those it has oftener than its language."""
    local = found.where("term is not null").select("lang", "a", "term", "n", "lang_n", "value")
    salted = local.repartition("lang", "a", F.pmod(F.xxhash64("term"), F.lit(SALTS))).mapInArrow(_merged(k), local.schema)
    merged = salted.repartition("lang", "a").mapInArrow(_merged(k), local.schema)
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "term")
    best = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = totals.select("lang", F.posexplode("sources").alias("a", "s")).select("lang", "a", F.col("s.source").alias("source"))
    return best.join(named, ["lang", "a"]).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_distances(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each source against each other of its language, the farthest first."""
    sums = found.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = totals.select("lang", "sources", F.posexplode("sources").alias("i", "s")).select("lang", "i", F.col("s.source").alias("source"), F.posexplode("sources").alias("j", "other"))
    pairs = named.where("i != j").select("lang", "source", F.col("other.source").alias("item"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    valued = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: other sources by distance; part ``term``: the ``top`` terms that tell the source.

    Terms are runs of ASCII letters, taken small, and of characters beyond ASCII; a language keeps those in ``least_docs`` of
    its documents or more. Shares are whole billionths of counts with 2 added, divergences their squared difference by their
    sum, rounded down: all arithmetic is exact. Ties go by the item's UTF-8.

    Null texts, languages and sources are empty strings. A source without kept terms has distances, from the added counts,
    and no terms; a language without kept terms has distances of 0; one with a single source has no pairs. Repeated rows
    count each; ids aren't looked at. Empty table: no rows. Other columns are ignored, whatever their names.

    Texts are read once. Shuffled are counts by task, language, source and term. Distances have a row a pair of sources, as asked, and take a step
    a term and pair.
    """
    blank = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    docs = docs.select(blank(lang_col, "lang"), blank(source_col, "source"), blank(text_col, "text"))
    terms = written(term_counts(docs, least_docs))
    totals = written(source_totals(docs, terms))
    found = written(compared(terms, totals, top))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(source_distances(found, totals), "pair").unionByName(part(telling_terms(found, totals, top), "term"))
