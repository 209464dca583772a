"""Bootstrap as a distributed job: replicates are rows, and each works out its own draws.

Draw j of replicate b picks row md5("seed-b-j") mod n, so that draws are the same on every engine and for every retry. A
replicate needs how often each row was drawn, running sums of that along each strategy's order, and sums by cell: no draw
is shuffled, joined or sorted. For this each task holds the rows it draws from, in a few numbers a row; where they are more
than ``MOST_HELD``, draws are rows that are joined, with the same result. Codes of draws are worked out side by side, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.relations import stored
from .ordered import positions

MEASURES = ["hit_raw", "lift_raw", "matched_lift_raw"]
MOST_HELD = 8_000_000  # rows; under 60 bytes each
SIDE_BY_SIDE = 1 << 14
_TURNS = [t for ts in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in ts * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]


def picked(n: int, seed: int, b: Column, j: Column) -> Column:
    code = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), b.cast("string"), j.cast("string"))), 1, 8)
    return F.pmod(F.conv(code, 16, 10).cast("bigint"), F.lit(n)).cast("int")


def draws(spark, n: int, n_boot: int, seed: int) -> DataFrame:
    """(b, j, pick): n picks of 0 to n - 1 for each replicate."""
    grid = spark.range(n_boot * n).select((F.col("id") / F.lit(n)).cast("int").alias("b"), F.pmod("id", F.lit(n)).cast("int").alias("j"))
    return grid.withColumn("pick", picked(n, seed, F.col("b"), F.col("j")))


def md5_codes(words: list, size: int) -> np.ndarray:
    """The first eight hex digits of the md5 of many messages of one block, as numbers. ``words``: the block's 16 words, arrays or numbers."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(size, x, np.uint32) for x in start)
    f, g = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three steps don't reach these digits
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
            w = i
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
            w = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
            w = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
            w = 7 * i % 16
        f += a
        if isinstance(words[w], int):
            f += np.uint32((_SINES[i] + words[w]) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += words[w]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), g), np.left_shift(f, np.uint32(_TURNS[i]), f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(start[0])).byteswap()


@cache
def _digits(low: int, high: int) -> np.ndarray:
    """The decimal digits of ``low`` to ``high`` - 1, numbers of one length, as characters: a row a number."""
    return np.arange(low, high).astype(f"S{len(str(low))}").view(np.uint8).reshape(high - low, -1)


def drawn(n: int, seed: int, b: int) -> np.ndarray:
    """The n picks of replicate ``b``: as ``picked`` says, many at once."""
    out, prefix = np.empty(n, np.int64), f"{seed}-{b}-".encode()
    for width in range(1, len(str(max(n - 1, 0))) + 1):
        low, high = 10 ** (width - 1) if width > 1 else 0, min(n, 10**width)
        length = len(prefix) + width
        block = np.zeros((SIDE_BY_SIDE, -(-(length + 1) // 4) * 4), np.uint8)
        if block.shape[1] > 56:
            raise ValueError("seed and replicate have too many digits")
        block[:, : len(prefix)], block[:, length] = np.frombuffer(prefix, np.uint8), 0x80
        for at in range(low, high, SIDE_BY_SIDE):
            end = min(at + SIDE_BY_SIDE, high)
            block[: end - at, len(prefix) : length] = _digits(at, end)
            own = block[: end - at].view("<u4")
            words: list = [np.ascontiguousarray(own[:, w]) for w in range(own.shape[1])]
            words += [0] * (14 - len(words)) + [8 * length, 0]
            out[at:end] = md5_codes(words, end - at) % np.uint32(n)
    return out


def replicate_ids(spark, n_boot: int, first: int = 0) -> DataFrame:
    """(b): a row a replicate, dealt to all cores."""
    tasks = max(1, min(n_boot, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(first, n_boot, 1, tasks).select(F.col("id").cast("int").alias("b"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows numbered from 0 by ``key``, which tells them apart."""
    return positions(df, [], [F.col(key)], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def interval(table: DataFrame, by: list[str], measures: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Ends of the middle 95 % over replicates: a group has a row a replicate."""
    ends = [F.percentile(m, F.lit(q)).alias(f"{m}_ci_{name}") for m in measures for q, name in ((low, "low"), (high, "high"))]
    return table.groupBy(*by).agg(*ends) if by else table.agg(*ends)


def pick_measures(df: DataFrame, by: list[str], sizes: list[tuple[str, str, int]], order: list[str]) -> DataFrame:
    """Hit rate, lift and matched lift of each (strategy, k, size) within each group: cell and base rates come from the group's own rows.

    Scores are columns s_<strategy>; equal ones are taken by ``order``.
    """
    rose, known = (F.col("outcome_log_change") > 0).cast("double"), F.col("has_outcome")
    cell = Window.partitionBy(*by, "cell")
    rate = F.sum(F.when(known, rose)).over(cell) / F.greatest(F.count(F.when(known, rose)).over(cell), F.lit(1))
    df = df.withColumns({"_rate": F.coalesce(rate, F.lit(0.0)), "_base": F.avg(F.when(known, rose)).over(Window.partitionBy(*by))})
    scores = F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(k).alias("k"), F.col(f"s_{n}").cast("double").alias("score"), F.lit(size).alias("_size")) for n, k, size in sizes)))
    long = df.select("*", scores).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "strategy", "k").orderBy(F.col("score").desc_nulls_last(), *order)))
    flagged = long.where("score is not null and has_outcome and _r <= _size")
    t = flagged.groupBy(*by, "strategy", "k").agg(F.avg(rose).alias("hit_raw"), F.first("_base").alias("_base"), F.avg("_rate").alias("_expected"))
    safe = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return t.select(*by, "strategy", "k", "hit_raw", (F.col("hit_raw") / safe("_base")).alias("lift_raw"), (F.col("hit_raw") / safe("_expected")).alias("matched_lift_raw"))


class Season:
    """The rows that replicates draw from, as arrays: cells, outcomes, and the order of each strategy's scores."""

    def __init__(self, cell: np.ndarray, known: np.ndarray, rose: np.ndarray, scores: dict[str, np.ndarray]):
        self.cell, self.known, self.rose = cell.astype(np.int32), known.astype(bool), known & (rose > 0)
        self.n_cells = int(cell.max(initial=-1)) + 1
        self.orders = {}
        for name, s in scores.items():
            order = np.argsort(-s, kind="stable")[: np.count_nonzero(~np.isnan(s))]  # NaN last
            starts = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]]) if len(order) else np.zeros(0, int)
            self.orders[name] = (order.astype(np.int32), starts.astype(np.int32))

    def flagged(self, strategy: str, size: int, picks: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and how many draws of each are among the first ``size`` by score: of equal scores, those drawn first."""
        order, starts = self.orders[strategy]
        seen = min(len(order), 2 * size + 1000)
        through = np.cumsum(times[order[:seen]])
        while seen < len(order) and through[-1] <= size:
            seen = min(len(order), 2 * seen)
            through = np.cumsum(times[order[:seen]])
        full = int(np.searchsorted(through, size, "right"))  # rows whose draws all fit
        if full >= len(order):
            return order, times[order]
        tie = int(np.searchsorted(starts, full, "right")) - 1
        low, high = starts[tie], starts[tie + 1] if tie + 1 < len(starts) else len(order)
        room = int(size - (through[low - 1] if low else 0))
        equal = np.zeros(len(times), bool)
        equal[order[low:high]] = True
        first, counts = np.unique(picks[np.flatnonzero(equal[picks])[:room]], return_counts=True)
        return np.concatenate([order[:low], first]), np.concatenate([times[order[:low]], counts])

    def measures(self, sizes: list[tuple[str, str, int]], picks: np.ndarray) -> Iterator[tuple]:
        """(strategy, k, hit_raw, lift_raw, matched_lift_raw) of one replicate; a strategy without a flagged outcome has no row."""
        times = np.bincount(picks, minlength=len(self.cell))
        seen, hits = times * self.known, times * self.rose
        rate = np.bincount(self.cell, hits, self.n_cells) / np.maximum(np.bincount(self.cell, seen, self.n_cells), 1)
        base = hits.sum() / seen.sum() if seen.sum() else 0.0
        for strategy, k, size in sizes:
            rows, chosen = self.flagged(strategy, size, picks, times)
            chosen = chosen * self.known[rows]
            if total := chosen.sum():
                hit, expected = (chosen * self.rose[rows]).sum() / total, (chosen * rate[self.cell[rows]]).sum() / total
                yield strategy, k, hit, hit / base if base else None, hit / expected if expected else None


def _season(rows: DataFrame, strategies: list[str]) -> Season:
    """At most ``MOST_HELD`` rows (idx, cell, has_outcome, outcome_log_change, scores), by idx."""
    true = lambda c: F.coalesce(c, F.lit(False))
    t = rows.select("idx", F.coalesce("cell", F.lit("")).alias("cell"), true(F.col("has_outcome")).alias("known"), true(F.col("outcome_log_change") > 0).alias("rose"), *(F.col(f"s_{s}").cast("double").alias(f"s_{s}") for s in strategies)).toArrow()
    order = np.argsort(t["idx"].to_numpy(), kind="stable")
    cells = pa.chunked_array(t["cell"]).combine_chunks().dictionary_encode().indices if t.num_rows else pa.array([], pa.int32())
    column = lambda name: t[name].to_numpy()[order]
    return Season(cells.to_numpy(zero_copy_only=False)[order], column("known"), column("rose"), {s: column(f"s_{s}").astype(float) for s in strategies})


def _replicates(spark, season: Season, n: int, sizes: list[tuple[str, str, int]], n_boot: int, seed: int) -> DataFrame:
    """(b, strategy, k, measures): every replicate, and as b = -1 the rows themselves, each once."""
    shared = spark.sparkContext.broadcast(season)

    def run(batches):
        for batch in batches:
            found = [(b, *row) for b in batch.column("b").to_pylist() for row in shared.value.measures(sizes, np.arange(n) if b < 0 else drawn(n, seed, b))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 6, (pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 3), strict=True)], ["b", "strategy", "k", *MEASURES])

    return replicate_ids(spark, n_boot, -1).mapInArrow(run, "b int, strategy string, k string, hit_raw double, lift_raw double, matched_lift_raw double")


def bootstrap_picks(df: DataFrame, sizes: list[tuple[str, str, int]], key: str, n_boot: int = 2000, seed: int = 42, held: bool | None = None) -> DataFrame:
    """Point values and 95 % intervals of ``MEASURES`` for each (strategy, k, size), k being the size's name, in one job: each replicate
    draws rows anew, picks anew and works out its own rates. Scores are columns s_<strategy>; null is never picked.

    ``df`` is one scored season. ``held`` says whether tasks hold its rows; by default its size does. No rows: no rows.
    """
    strategies = list(dict.fromkeys(s for s, *_ in sizes))
    rows = numbered(df.select(key, "has_outcome", "outcome_log_change", "cell", *(f"s_{s}" for s in strategies)), key).persist()
    n = rows.count()
    if n and (n <= MOST_HELD if held is None else held):
        every = stored(_replicates(df.sparkSession, _season(rows, strategies), n, sizes, n_boot, seed))
        points, replicates = every.where("b < 0").drop("b"), every.where("b >= 0")
        return points.join(interval(replicates, ["strategy", "k"], MEASURES), ["strategy", "k"])
    points = pick_measures(rows.withColumn("b", F.lit(0)), ["b"], sizes, ["idx"]).drop("b")
    if not n:
        return points.join(interval(points, ["strategy", "k"], MEASURES), ["strategy", "k"])
    joined = draws(df.sparkSession, n, n_boot, seed).join(rows, F.col("pick") == F.col("idx"))
    replicates = pick_measures(joined, ["b"], sizes, ["j"])
    return points.join(interval(replicates, ["strategy", "k"], MEASURES), ["strategy", "k"])


def bootstrap_rmse_difference(df: DataFrame, y: str, a: str, b: str, key: str, n_boot: int = 2000, seed: int = 42, held: bool | None = None) -> DataFrame:
    """RMSE of a less that of b on the same rows, with a 95 % interval: squared errors once, then sums over each replicate's draws."""
    rows = numbered(df.select(key, ((F.col(a) - F.col(y)) ** 2).alias("_a"), ((F.col(b) - F.col(y)) ** 2).alias("_b")), key).persist()
    n, spark = rows.count(), df.sparkSession
    difference = F.sqrt(F.avg("_a")) - F.sqrt(F.avg("_b"))
    if n and (n <= MOST_HELD if held is None else held):
        t = rows.select("idx", "_a", "_b").toArrow()
        shared = spark.sparkContext.broadcast(np.stack([t[c].to_numpy().astype(float) for c in ("_a", "_b")], 1)[np.argsort(t["idx"].to_numpy())])

        def run(batches):
            squares, there = np.nan_to_num(shared.value, nan=0.0, posinf=np.inf), ~np.isnan(shared.value)
            for batch in batches:
                counts = (np.bincount(drawn(n, seed, b), minlength=n) for b in batch.column("b").to_pylist())
                roots = [np.sqrt((times @ squares) / (times @ there)) for times in counts]
                yield pa.RecordBatch.from_arrays([pa.array([x - z for x, z in roots], pa.float64())], ["diff"])

        replicates = replicate_ids(spark, n_boot).mapInArrow(run, "diff double")
    else:
        replicates = draws(spark, max(n, 1), n_boot if n else 0, seed).join(rows, F.col("pick") == F.col("idx")).groupBy("b").agg(difference.alias("diff"))
    return rows.agg(difference.alias("diff")).crossJoin(interval(replicates, [], ["diff"]))  # one row each
