"""Would the picks have worked? Rates, lifts against all and against like cells, ranks, missing outcomes, floors, bootstrap.

All strategies, sizes and floors are rows of one long table, so that each report is one grouped pass. Ranks are taken
within a universe (a season, or a season above a floor) and a strategy.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C
from ..sources.relations import stored
from .ordered import average_ranks
from .resample import bootstrap_picks
from .select import medians, top_k


def universes(df: DataFrame, floors: list[float], value: str = "target_value") -> DataFrame:
    """A copy of the rows for each floor that their value reaches."""
    return df.select("*", F.explode(F.array(*(F.lit(float(f)) for f in floors))).alias("floor")).where(F.col(value) >= F.col("floor"))


def picks(df: DataFrame, names: list[str], sizes: dict[str, int | None], by: list[str], key: str) -> DataFrame:
    """Long table: a row for each row, strategy and size, with ``flagged``. None as a size is the top decile; ``all`` flags every row.

    Rows without a score are never flagged; equal scores are taken in the order of ``key``. No universe is sorted in one
    task: the score at a size's place is found by counting, and only rows that tie with it are put in order.
    """
    scores = lambda some: F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(f"s_{n}").cast("double").alias("score")) for n in some)))
    ranked, out = [n for n in names if n != "all"], []
    if ranked:
        size_of = lambda size: (F.ceil(F.col("_n") / 10) if size is None else F.lit(size)).cast("bigint").alias("size")
        options = F.inline(F.array(*(F.struct(F.lit(k).alias("k"), size_of(size)) for k, size in sizes.items())))
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array(*map(F.lit, ranked)).alias("_ranked"))
        wanted = counts.select(*by, "_n", F.explode("_ranked").alias("strategy")).select(*by, "strategy", options)
        out.append(top_k(df.select("*", scores(ranked)), [*by, "strategy"], "score", key, wanted).withColumnRenamed("chosen", "flagged"))
    if "all" in names:
        out.append(df.select("*", scores(["all"]), F.lit("all").alias("k"), F.lit(None).cast("bigint").alias("size"), F.lit(True).alias("flagged")))
    return reduce(DataFrame.unionByName, out)


def cell_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the rates of its cell and of its universe: over rows with an outcome, and over all with a missing one as a failure."""
    rose = F.coalesce((F.col("outcome_log_change") > 0).cast("double"), F.lit(0.0))
    known = lambda c: F.avg(F.when(F.col("has_outcome"), F.col(c)))
    cells = df.groupBy(*by, "cell").agg(
        known("hit_raw").alias("cell_hit_raw"), known("hit_rel").alias("cell_hit_rel"), known("outcome_log_change").alias("cell_change_raw"),
        known("outcome_rel_change").alias("cell_change_rel"), F.avg(rose).alias("cell_rose"),
    )
    whole = df.groupBy(*by).agg(known("hit_raw").alias("base_hit_raw"), known("hit_rel").alias("base_hit_rel"), F.avg(rose).alias("base_rose"))
    return df.join(cells, [*by, "cell"]).join(whole, by)


def evaluate(df: DataFrame, names: list[str], sizes: dict[str, int | None], by: list[str], key: str) -> DataFrame:
    """22 measures for each universe, strategy and size, from one grouped pass over the flagged rows and exact medians by counting."""
    keys = [*by, "strategy", "k"]
    rows = stored(picks(cell_rates(df, by), names, sizes, by, key).where("flagged"))
    has = F.col("has_outcome")
    mean = lambda c: F.avg(F.when(has, F.col(c)))
    hits, n = F.coalesce(F.sum(F.when(has, F.col("hit_raw"))), F.lit(0)), F.count_if(has)
    low, high = K.wilson(F.col("_hits"), F.col("n_with_outcome"))
    one = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_flagged"), n.alias("n_with_outcome"), hits.alias("_hits"), mean("hit_raw").alias("hit_raw"), mean("hit_rel").alias("hit_rel"),
        mean("outcome_log_change").alias("mean_log_change"), mean("outcome_rel_change").alias("mean_rel_change"),
        F.first("base_hit_raw").alias("_base_raw"), F.first("base_hit_rel").alias("_base_rel"),
        F.first("base_rose").alias("_base_rose"), mean("cell_hit_raw").alias("matched_expected_hit_raw"), mean("cell_hit_rel").alias("matched_expected_hit_rel"),
        F.avg(F.when(has, F.col("outcome_log_change") - F.col("cell_change_raw"))).alias("matched_excess_log_change"),
        F.avg(F.when(has, F.col("outcome_rel_change") - F.col("cell_change_rel"))).alias("matched_excess_rel_change"), F.avg("cell_rose").alias("_cell_rose"),
    )
    one = one.join(medians(rows.where(has), keys, {"median_log_change": F.col("outcome_log_change"), "median_rel_change": F.col("outcome_rel_change")}), keys, "left")
    as_fail = F.col("_hits") / F.col("n_flagged")
    return one.select(
        *by, "strategy", "k", "n_flagged", "n_with_outcome", (1 - F.col("n_with_outcome") / F.col("n_flagged")).alias("missing_rate"), "hit_raw",
        low.alias("hit_raw_ci_low"), high.alias("hit_raw_ci_high"), "hit_rel", "mean_log_change", "median_log_change", "mean_rel_change", "median_rel_change",
        K.ratio(F.col("hit_raw"), F.col("_base_raw")).alias("lift_raw"), K.ratio(F.col("hit_rel"), F.col("_base_rel")).alias("lift_rel"), "matched_expected_hit_raw",
        K.ratio(F.col("hit_raw"), F.col("matched_expected_hit_raw")).alias("matched_lift_raw"), "matched_expected_hit_rel",
        K.ratio(F.col("hit_rel"), F.col("matched_expected_hit_rel")).alias("matched_lift_rel"), "matched_excess_log_change", "matched_excess_rel_change",
        as_fail.alias("hit_raw_missing_as_fail"), K.ratio(as_fail, F.col("_base_rose")).alias("lift_raw_missing_as_fail"),
        K.ratio(as_fail, F.col("_cell_rose")).alias("matched_lift_raw_missing_as_fail"),
    )


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal, by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def missingness(df: DataFrame, names: list[str], by: list[str], key: str, size: int | None = None) -> DataFrame:
    """Do flagged rows lack an outcome more often? Pooled z-test of two shares, for the top decile unless a size is given."""
    rows = picks(df, names, {"k": size}, by, key)
    lost = (~F.col("has_outcome")).cast("double")
    a, b = F.col("flagged"), ~F.col("flagged")
    t = rows.groupBy(*by, "strategy").agg(
        F.avg(F.when(a, lost)).alias("missing_flagged"), F.avg(F.when(b, lost)).alias("missing_others"), F.avg(lost).alias("_p"), F.count_if(a).alias("_a"), F.count_if(b).alias("_b")
    )
    se = F.sqrt(F.col("_p") * (1 - F.col("_p")) * (1 / F.nullif(F.col("_a").cast("double"), F.lit(0.0)) + 1 / F.nullif(F.col("_b").cast("double"), F.lit(0.0))))
    difference = F.col("missing_flagged") - F.col("missing_others")
    z = F.when(se > 0, difference / se).otherwise(0.0)
    return t.select(*by, "strategy", "missing_flagged", "missing_others", difference.alias("difference"), z.alias("z"), normal_tail(z).alias("p_value"))


def rank_correlation(df: DataFrame, names: list[str], outcomes: list[str], by: list[str], key: str) -> DataFrame:
    """Spearman's correlation of score and outcome over rows that have both, with Fisher's 95 % interval.

    Ranks come from rows dealt by ranges of their values, so a season lies in many tasks; ``key`` deals equal values.
    """
    pairs = F.inline(F.array(*(
        F.struct(F.lit(n).alias("strategy"), F.lit(o).alias("outcome"), F.col(f"s_{n}").cast("double").alias("_s"), F.col(o).cast("double").alias("_o")) for n in names for o in outcomes
    )))
    keys = [*by, "strategy", "outcome"]
    rows = df.where("has_outcome").select(*by, F.col(key).alias("_key"), pairs).where("_s is not null and _o is not null")
    ranks = average_ranks(average_ranks(rows, keys, "_s", "_key", "_rs"), keys, "_o", "_key", "_ro")
    t = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rs", "_ro").alias("ic"))
    half = 1.96 / F.sqrt(F.nullif((F.col("n") - 3).cast("double"), F.lit(0.0)))
    return t.select(*keys, "n", "ic", F.tanh(F.atanh("ic") - half).alias("ci_low"), F.tanh(F.atanh("ic") + half).alias("ci_high"))


def pivot_report(table: DataFrame, rows: str, columns: str, values: list, measure: str) -> DataFrame:
    return table.groupBy(rows).pivot(columns, values).agg(F.first(measure))


def headline(results: DataFrame, bootstrap: DataFrame, on: list[str]) -> DataFrame:
    """Results with the bootstrap's interval where there is one, else Wilson's."""
    b = bootstrap.select(*on, F.col("hit_raw_ci_low").alias("_lo"), F.col("hit_raw_ci_high").alias("_hi"), F.col("matched_lift_raw_ci_low").alias("matched_low"), F.col("matched_lift_raw_ci_high").alias("matched_high"))
    return results.join(F.broadcast(b), on, "left").withColumns({  # a row a strategy and size
        "ci_low": F.coalesce("_lo", "hit_raw_ci_low"), "ci_high": F.coalesce("_hi", "hit_raw_ci_high"), "ci_kind": F.when(F.col("_lo").isNotNull(), "bootstrap").otherwise("wilson"),
    }).drop("_lo", "_hi")


def headline_bootstrap(df: DataFrame, rows: list[tuple[str, str]], sizes: dict[str, int | None], key: str, n_boot: int = 2000) -> DataFrame:
    """Bootstrap intervals of the (strategy, size) rows of a report, in one job. The top decile is of the season's rows."""
    n = df.count()
    size = {k: math.ceil(n / 10) if v is None else v for k, v in sizes.items()}
    return bootstrap_picks(df, [(s, k, size[k]) for s, k in rows], key, n_boot)


def keep_feature(gain: Column, ci_low: Column, ci_high: Column) -> Column:
    """Keep what lowers the error by 0.010 or more, if the interval of the difference (with minus without) leaves out 0."""
    return (-gain >= C.KEEP_GAIN) & ((ci_low > 0) | (ci_high < 0))
