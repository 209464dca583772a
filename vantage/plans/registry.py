"""All queries of the library outside the subpackage for training data, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C
from ..operators import activity as A
from ..operators import asof as J
from ..operators import audit as D
from ..operators import backtest as B
from ..operators import explain as X
from ..operators import groups as G
from ..operators import learners as L
from ..operators import market as M
from ..operators import resample as R
from ..operators import scoring as S
from ..operators import serve as Q
from ..operators.cleaning import clamp, keep_first, undisclosed
from ..operators.stages import load_model, save_model
from ..sources.relations import as_of, fresh_folder
from . import live as V
from . import oracle as O
from .orders import FEATURES, FLAGGED, KEY, STRATEGIES, TRAIN_LAST, VALUE_FLOOR, World, lines, panel, scored, table, values, with_fit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r4(*names: str) -> list[Column]:
    return [(F.round(F.col(n).cast("double"), 4) + 0.0).alias(n) for n in names]


def q4(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 4) + 0.0 AS {n}" for n in names)


# Cleaning -------------------------------------------------------------------------------------------------------------

RANKED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}, " + O.LINE_ORDER + ") AS rn FROM lineitem"


@query("SELECT o_orderpriority, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30' GROUP BY 1")
def asof_truncate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return as_of(orders, "day", "1998-06-30").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM ({RANKED.format(order='l_quantity DESC')}) WHERE rn = 1")
def dedup_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM ({RANKED.format(order='(l_returnflag = $$R$$) DESC')}) WHERE rn = 1")
def dedup_flag_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], (F.col("l_returnflag") == "R").desc_nulls_last())
    return one.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(O.world("SELECT entity, date, round(value, 2) AS value FROM vals"))
def clean_value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("entity", "date", F.round("value", 2).alias("value"))


@query("""SELECT l_returnflag, count(*) AS n, count(fee) AS n_disclosed, count(*) FILTER (fee = 0) AS n_free, round(count(fee) / count(*), 4) AS disclosed_share, round(sum(fee), 2) AS fees
    FROM (SELECT l_returnflag, CASE WHEN l_tax > 0.02 THEN l_discount END AS fee FROM lineitem) GROUP BY 1""")
def null_vs_zero_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("l_tax") > 0.02, F.col("l_discount")).otherwise(-1.0)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", undisclosed(raw).alias("fee"))
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("fee").alias("n_disclosed"), F.count_if(F.col("fee") == 0).alias("n_free"),
        F.round(F.count("fee") / F.count(F.lit(1)), 4).alias("disclosed_share"), F.round(F.sum("fee"), 2).alias("fees"),
    )


RAW_POSITIONS = [" centre-back ", "ATTACK", "missing", "", "Second Striker", "sweeper", "goalkeeper", "wing-back"]
RAW_FEET = ["Left ", "right", "BOTH", "two", ""]


@query("""SELECT position, position_group, foot, count(*) AS n FROM (SELECT
    CASE c_custkey % 8 WHEN 0 THEN 'Centre-Back' WHEN 1 THEN 'Attack' WHEN 4 THEN 'Second Striker' WHEN 5 THEN 'Centre-Back' WHEN 6 THEN 'Goalkeeper' END AS position,
    CASE c_custkey % 8 WHEN 0 THEN 'Defender' WHEN 1 THEN 'Attack' WHEN 4 THEN 'Attack' WHEN 5 THEN 'Defender' WHEN 6 THEN 'Goalkeeper' END AS position_group,
    CASE c_custkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'both' ELSE 'unknown' END AS foot FROM customer) GROUP BY ALL""")
def category_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda raw: F.array(*map(F.lit, raw))[(F.col("c_custkey") % len(raw)).cast("int")]
    rows = table(spark, sf_dir, "customer").select(K.normalize_position(pick(RAW_POSITIONS)).alias("position"), K.normalize_foot(pick(RAW_FEET)).alias("foot"))
    return rows.withColumn("position_group", K.position_group(F.col("position"))).groupBy("position", "position_group", "foot").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size END AS size, nullif(trim(CASE WHEN p_size % 7 = 0 THEN '  ' ELSE ' ' || p_brand END), '') AS brand,
    least(greatest(coalesce(CASE WHEN p_size % 5 > 0 THEN p_size - 20 END, 0), 0), 25) AS clamped FROM part""")
def range_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    raw = F.when(size % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", K.in_range(size, 10, 40).alias("size"), K.non_blank(raw).alias("brand"), clamp(F.when(size % 5 > 0, size - 20), 0, 25).alias("clamped"))


# Seasons, groups ------------------------------------------------------------------------------------------------------


@query(O.world("SELECT league, season, start_date, end_date, n_games, n_clubs, complete FROM cal"))
def season_calendar_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).calendar.select("league", "season", "start_date", "end_date", "n_games", "n_clubs", "complete")


@query(O.world("SELECT entity, season, league, club_id FROM aff"))
def main_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.main_affiliation(World.of(spark, sf_dir).activity, KEY, ["league", "club_id"], "minutes").select(*KEY, "league", "club_id")


FACTS = ["entity", "season", "league", "club_id", "apps", "minutes", "goals", "league_minutes", "n_clubs_season", "last_app"]


@query(O.world(f"SELECT {', '.join(FACTS)} FROM facts"))
def bounded_activity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).facts.select(*FACTS)


@query("""SELECT entity, season, category FROM (SELECT entity, season, category, row_number() OVER (PARTITION BY entity, season ORDER BY n DESC, category IN ('5-LOW', '4-NOT SPECIFIED'), category) AS rn
    FROM (SELECT o_custkey AS entity, year(CAST(o_orderdate AS DATE)) AS season, o_orderpriority AS category, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL)) WHERE rn = 1""")
def modal_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.year(F.col("o_orderdate").cast("date")).cast("bigint").alias("season"), F.col("o_orderpriority").alias("category"))
    return A.modal_category(rows, KEY, "category", ("5-LOW", "4-NOT SPECIFIED"))


SIDES = """SELECT CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) AS season, CAST(l_shipdate AS DATE) AS date, l_suppkey AS club_id, CAST(l_quantity AS BIGINT) AS gf, CAST(l_linenumber AS BIGINT) * 7 AS ga,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_linenumber AS BIGINT) END AS pos FROM lineitem
    UNION ALL SELECT year(CAST(l_shipdate AS DATE)), CAST(l_shipdate AS DATE), l_partkey % 50 + 1, CAST(l_linenumber AS BIGINT) * 7, CAST(l_quantity AS BIGINT), NULL FROM lineitem"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    games = table(spark, sf_dir, "lineitem").select(
        F.year(day).cast("bigint").alias("season"), day.alias("date"), F.col("l_suppkey").alias("h"), (F.col("l_partkey") % 50 + 1).alias("a"), F.col("l_quantity").cast("bigint").alias("hg"),
        (F.col("l_linenumber").cast("bigint") * 7).alias("ag"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("bigint")).alias("hp"), F.lit(None).cast("bigint").alias("ap"),
    )
    return G.two_sided(games, ["season", "date"], {"club_id": "h", "gf": "hg", "ga": "ag", "pos": "hp"}, {"club_id": "a", "gf": "ag", "ga": "hg", "pos": "ap"})


@query(f"""WITH s AS ({SIDES}) SELECT club_id, season, count(*) AS games, round(avg(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END), 4) AS ppg, round(avg(gf - ga), 4) + 0.0 AS gd_per_game FROM s GROUP BY 1, 2""")
def two_sided_long_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.results(_sides(spark, sf_dir), ["club_id", "season"]).select("club_id", "season", "games", *r4("ppg", "gd_per_game"))


@query(f"""WITH s AS ({SIDES}), c AS (SELECT DISTINCT club_id, season FROM s), k AS (SELECT club_id, season, pos, row_number() OVER (PARTITION BY club_id, season ORDER BY date DESC, pos DESC) AS rn FROM s WHERE pos IS NOT NULL)
    SELECT c.club_id, c.season, k.pos AS last_rank FROM c LEFT JOIN k ON k.club_id = c.club_id AND k.season = c.season AND rn = 1""")
def last_known_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.results(_sides(spark, sf_dir), ["club_id", "season"]).select("club_id", "season", "last_rank")


@query("""SELECT s_suppkey, count(DISTINCT e.season) AS seasons FROM supplier LEFT JOIN (
    SELECT l_suppkey AS club_id, year(CAST(l_shipdate AS DATE)) AS season FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45
    UNION SELECT l_partkey % 50 + 1, year(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) e ON e.club_id = s_suppkey GROUP BY 1""")
def membership_flag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_suppkey", (F.col("l_partkey") % 50 + 1).alias("other"), F.year(F.col("l_shipdate").cast("date")).alias("season"))
    found = G.members(events, ["l_suppkey", "other"], ["season"])
    return table(spark, sf_dir, "supplier").join(found, F.col("s_suppkey") == F.col("club_id"), "left").groupBy("s_suppkey").agg(F.count("season").alias("seasons"))


@query(O.world("""SELECT a.club_id, a.season, count(DISTINCT entity) AS used, round(sum(minutes * age) / nullif(sum(minutes) FILTER (age IS NOT NULL), 0), 4) AS mean_age,
    round(coalesce(sum(minutes) FILTER (c_mktsegment <> 'BUILDING'), 0) / nullif(sum(minutes), 0), 4) AS foreign_share
    FROM act a LEFT JOIN (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN 16 + c_custkey % 25 END AS age FROM customer) ON c_custkey = entity GROUP BY 1, 2"""))
def weighted_avg_null_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment", F.when(F.col("c_acctbal") > 0, 16 + F.col("c_custkey") % 25).alias("age"))
    rows = World.of(spark, sf_dir).activity.join(people, "entity", "left")
    return rows.groupBy("club_id", "season").agg(
        F.countDistinct("entity").alias("used"), F.round(G.weighted_mean(F.col("age"), F.col("minutes")), 4).alias("mean_age"),
        F.round(G.share(F.col("c_mktsegment") != "BUILDING", F.col("minutes")), 4).alias("foreign_share"),
    )


@query("""WITH m AS (SELECT o_custkey AS entity, year(CAST(l_shipdate AS DATE)) AS season, l_suppkey AS into_id, l_partkey % 50 + 1 AS out_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS DOUBLE) END AS fee
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    f AS (SELECT club_id, season, coalesce(sum(fee) FILTER (dir = 'in'), 0) AS fees_in, coalesce(sum(fee) FILTER (dir = 'out'), 0) AS fees_out, count(*) AS n_moves, count(fee) / count(*) AS disclosed_share, max(date) AS last_move
        FROM (SELECT into_id AS club_id, 'in' AS dir, season, date, fee FROM m UNION ALL SELECT out_id, 'out', season, date, fee FROM m) GROUP BY 1, 2),
    own AS (SELECT entity, into_id AS club_id, season, sum(fee) AS own FROM m GROUP BY 1, 2, 3)
    SELECT own.entity, own.season, own.club_id, fees_in - coalesce(own, 0) AS fees_in_without_own, fees_out, n_moves, round(disclosed_share, 4) AS disclosed_share, last_move FROM own JOIN f ON f.club_id = own.club_id AND f.season = own.season""")
def flow_in_out_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    moves = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity")), "l_orderkey").select(
        "entity", F.year(day).cast("bigint").alias("season"), F.col("l_suppkey").alias("into_id"), (F.col("l_partkey") % 50 + 1).alias("out_id"), day.alias("date"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("double")).alias("fee"),
    )
    totals = G.flows(G.in_and_out(moves, ["season", "date", "fee"], "into_id", "out_id"), ["club_id", "season"])
    own = moves.groupBy("entity", F.col("into_id").alias("club_id"), "season").agg(F.sum("fee").alias("own"))
    return own.join(totals, ["club_id", "season"]).select("entity", "season", "club_id", G.without_own(F.col("fees_in"), F.col("own")).alias("fees_in_without_own"), "fees_out", "n_moves", *r4("disclosed_share"), "last_move")


# The value series -----------------------------------------------------------------------------------------------------


@query(O.world("SELECT season, asof_date, league, round(idx, 4) AS idx, n_entities FROM idx"))
def market_index_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).index.select("season", "asof_date", "league", *r4("idx"), "n_entities")


def _asof(strict: bool) -> str:
    sign = "<" if strict else "<="
    return f"""WITH p AS (SELECT event_id, user_id, date_trunc('hour', ts) AS at FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, date_trunc('hour', ts) AS ts, value FROM events WHERE event_type = 'view'),
    m AS (SELECT p.event_id, s.ts, s.value, row_number() OVER (PARTITION BY p.event_id ORDER BY s.ts DESC, s.value DESC) AS rn FROM p JOIN s ON s.user_id = p.user_id AND s.ts {sign} p.at)
    SELECT p.event_id, p.user_id, m.value FROM p LEFT JOIN m ON m.event_id = p.event_id AND rn = 1"""


def _asof_query(spark: SparkSession, sf_dir: str, strict: bool, method: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", "ts"))
    probes = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    series = events.where("event_type = 'view'").select("user_id", "ts", "value")
    return J.asof_backward(probes, series, ["user_id"], "at", "ts", ["value"], strict=strict, method=method).select("event_id", "user_id", "value")


@query(_asof(False))
def asof_latest_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof_query(spark, sf_dir, False, "window")


@query(_asof(True))
def asof_latest_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof_query(spark, sf_dir, True, "window")


@query(_asof(False))
def asof_latest_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof_query(spark, sf_dir, False, "range")


@query(O.world("SELECT entity, season, round(target_value, 2) AS target_value, target_date FROM tgt"))
def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).targets.select(*KEY, F.round("target_value", 2).alias("target_value"), "target_date")


@query(O.world("SELECT entity, season, round(last_update_log_change, 4) + 0.0 AS last_update_log_change, round(future_value, 2) AS future_value, future_date FROM later"))
def outcome_after_12m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).outcomes().select(*KEY, *r4("last_update_log_change"), F.round("future_value", 2).alias("future_value"), "future_date")


@query(O.world("SELECT entity, season, round(val_last, 2) AS val_last, val_hist_date, round(val_peak, 2) AS val_peak, round(val_season_start, 2) AS val_season_start, round(val_12m, 2) AS val_12m, val_cutoff FROM hist"))
def value_history_four_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda n: F.round(n, 2).alias(n)
    return World.of(spark, sf_dir).history().select(*KEY, two("val_last"), "val_hist_date", two("val_peak"), two("val_season_start"), two("val_12m"), "val_cutoff")


@query(O.world("SELECT f.entity, f.season, p.minutes AS prev_minutes, f.minutes - p.minutes AS minutes_delta, CAST(p.club_id <> f.club_id AS INT) AS changed_club FROM facts f LEFT JOIN facts p ON p.entity = f.entity AND p.season = f.season - 1"))
def prev_season_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = World.of(spark, sf_dir).facts
    both = rows.join(A.previous_season(rows, "entity", "season", ["minutes", "club_id"]), KEY, "left")
    return both.select(*KEY, "prev_minutes", (F.col("minutes") - F.col("prev_minutes")).alias("minutes_delta"), (F.col("prev_club_id") != F.col("club_id")).cast("int").alias("changed_club"))


@query(O.world("SELECT entity, season, l3_seasons, l3_minutes FROM l3"))
def trailing_three_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trailing(World.of(spark, sf_dir).facts, "entity", "season", {"minutes": "l3_minutes"}, "l3_seasons").select(*KEY, "l3_seasons", "l3_minutes")


@query(O.world("""SELECT g.season, round(g.idx, 4) AS idx, round(a.idx, 4) AS idx_1, round(b.idx, 4) AS idx_2 FROM (SELECT * FROM idx WHERE league = '_ALL') g
    LEFT JOIN idx a ON a.season = g.season + 1 AND a.league = '_ALL' LEFT JOIN idx b ON b.season = g.season + 2 AND b.league = '_ALL'"""))
def index_shifted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = World.of(spark, sf_dir).index
    at = [M.index_at(index, n, k) for n, k in (("idx", 0), ("idx_1", 1), ("idx_2", 2))]
    return at[0].join(at[1], "season", "left").join(at[2], "season", "left").select("season", *r4("idx", "idx_1", "idx_2"))


PANEL_EXACT = ["entity", "season", "name", "position_group", "league", "club_id", "start_date", "end_date", "target_date", "apps", "minutes", "goals", "league_minutes", "n_clubs_season", "changed_club", "prev_minutes",
               "minutes_delta", "l3_seasons", "l3_minutes", "days_since_val_last", "outcome_future_date", "last_app", "val_hist_date", "val_cutoff", "index_asof_date"]
PANEL_ROUNDED = ["target_value", "age", "goals_per90", "market_index", "league_index_rel", "y", "val_last_rel", "val_season_start_rel", "val_peak_rel", "val_12m_rel", "bt_last_update_log_change",
                 "outcome_future_value", "outcome_log_change", "outcome_rel_change"]


@query(O.world(f"SELECT {', '.join(PANEL_EXACT)}, {q4(*PANEL_ROUNDED)} FROM panel"))
def point_in_time_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select(*PANEL_EXACT, *r4(*PANEL_ROUNDED))


# Data quality ---------------------------------------------------------------------------------------------------------

REQUIRED = ("entity", "season", "league", "end_date", "target_date", "target_value", "minutes", "apps", "market_index", "y", "prev_minutes")
RANGES: dict[str, tuple] = {"age": (18, 39), "minutes": (50, None), "goals_per90": (0, 10), "target_value": (1, None)}
CHECKS = ("last_app <= end_date", "val_hist_date <= end_date", "val_hist_date < target_date", "index_asof_date <= end_date")
VALIDATED = ("minutes", "goals_per90", "l3_minutes", "val_last_rel")
RULE_SQL = {f"{c} is null": f"{c} IS NULL" for c in REQUIRED} | {f"{c} below {lo}": f"{c} < {lo}" for c, (lo, _) in RANGES.items()} | {f"{c} above {hi}": f"{c} > {hi}" for c, (_, hi) in RANGES.items() if hi is not None} | {
    "minutes exceed 130 per appearance": "minutes > apps * 130", "infinite feature value": " OR ".join(f"isinf(CAST({c} AS DOUBLE))" for c in VALIDATED),
    "y != ln(target_value) - market_index": "abs(y - (ln(target_value) - market_index)) > 1e-8 + 1e-5 * abs(ln(target_value) - market_index)",
    "target outside the season-end window": "abs(target_date - end_date) > 120",
} | {c: f"NOT ({c})" for c in CHECKS}


@query(O.world(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n_bad FROM panel" for n, c in RULE_SQL.items()) + """
    UNION ALL SELECT 'repeated key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM panel GROUP BY entity, season) UNION ALL SELECT 'panel is empty', CAST(count(*) = 0 AS BIGINT) FROM panel"""))
def panel_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the panel validator; some ranges are narrow, so that they find rows."""
    return D.validate_panel(panel(spark, sf_dir), KEY, VALIDATED, REQUIRED, RANGES, CHECKS)


THEN = "2000-06-30"
COMPARED = ["apps", "minutes", "goals", "club_id", "prev_minutes", "l3_minutes", "market_index", "val_last_rel", "val_peak_rel"]


@query(O.two_worlds(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (NOT coalesce(abs(a.{f} - b.{f}) <= 1e-9 * greatest(abs(a.{f}), abs(b.{f}), 1e-300), a.{f} IS NULL AND b.{f} IS NULL)) AS n_diff FROM panel a JOIN then_panel b ON b.entity = a.entity AND b.season = a.season" for f in COMPARED
) + " UNION ALL SELECT '_only_now', count(*) FROM panel a WHERE NOT EXISTS (SELECT 1 FROM then_panel b WHERE b.entity = a.entity AND b.season = a.season)", THEN))
def time_travel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = panel(spark, sf_dir), World.of(spark, sf_dir, THEN).panel
    gone = D.only_in(now, then, KEY).agg(F.count(F.lit(1)).alias("n_diff")).select(F.lit("_only_now").alias("feature"), "n_diff")
    return D.panel_diff(now, then, KEY, COMPARED).unionByName(gone)


CORRELATED = ["minutes", "apps", "goals", "age", "val_last_rel", "league_index_rel"]


@query(O.world(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}, y), 4) + 0.0 AS corr FROM panel" for f in CORRELATED)))
def feature_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.feature_correlations(panel(spark, sf_dir), CORRELATED).select("feature", *r4("corr"))


# Scores and errors ----------------------------------------------------------------------------------------------------

METRICS = ["rmse", "mae", "r2", "bias", "mae_eur", "medae_eur", "median_pct_error"]
METRIC_SQL = """count(*) AS n, round(sqrt(avg((y_hat - y) * (y_hat - y))), 4) AS rmse, round(avg(abs(y_hat - y)), 4) AS mae, round(1 - sum((y_hat - y) * (y_hat - y)) / nullif(count(y) * var_pop(y), 0), 4) + 0.0 AS r2,
    round(avg(y_hat - y), 4) + 0.0 AS bias, round(avg(abs({v} - target_value)), 1) AS mae_eur, round(quantile_cont(abs({v} - target_value), 0.5), 1) AS medae_eur, round(exp(quantile_cont(abs(y_hat - y), 0.5)) - 1, 4) AS median_pct_error"""


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *((F.round(m, 1).alias(m) if m.endswith("_eur") else r4(m)[0]) for m in METRICS))


@query(O.world(f"SELECT {METRIC_SQL.format(v='exp(y_hat + market_index)')} FROM (SELECT *, (SELECT avg(y) FROM panel WHERE season <= 1998) AS y_hat FROM panel WHERE season = 1999)"))
def baseline_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    return _metrics(L.metrics_of(L.mean_baseline(rows.where(F.col("season") <= TRAIN_LAST), rows.where(F.col("season") == FLAGGED))))


@query(O.world(f"SELECT {METRIC_SQL.format(v='exp(y_hat + market_index)')} FROM (SELECT *, coalesce(val_last_rel, (SELECT avg(y) FROM panel WHERE season <= 1998)) AS y_hat FROM panel WHERE season = 1999)"))
def baseline_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    return _metrics(L.metrics_of(L.last_value_baseline(rows.where(F.col("season") <= TRAIN_LAST), rows.where(F.col("season") == FLAGGED))))


@query(O.world("SELECT season, count(*) AS rows, round(quantile_cont(target_value, 0.5), 1) AS median_value, round(max(market_index), 4) + 0.0 AS market_index FROM panel GROUP BY season"))
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.panel_summary(panel(spark, sf_dir)).select("season", "rows", F.round("median_value", 1).alias("median_value"), *r4("market_index"))


MODELS = {"mean": "(SELECT avg(y) FROM panel WHERE season <= 1998)", "last_value": "coalesce(val_last_rel, (SELECT avg(y) FROM panel WHERE season <= 1998))", "least_squares": "y_hat"}


@query(O.scored("").rstrip() + ", models AS (" + " UNION ALL ".join(f"SELECT '{n}' AS model, sqrt(avg(({e} - y) * ({e} - y))) AS rmse FROM scored" for n, e in MODELS.items()) + """),
    top AS (SELECT row_number() OVER (ORDER BY rmse, model) AS place, model, rmse, rmse - min(rmse) OVER () AS gap FROM models)
SELECT place, model, round(rmse, 4) AS rmse, round(gap, 4) + 0.0 AS gap FROM top WHERE place <= 2""")
def best_and_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, valid = panel(spark, sf_dir), scored(spark, sf_dir)
    train, plain = rows.where(F.col("season") <= TRAIN_LAST), rows.where(F.col("season") == FLAGGED)
    fits = {"mean": L.mean_baseline(train, plain), "last_value": L.last_value_baseline(train, plain), "least_squares": valid}
    parts = [df.agg(F.sqrt(F.avg((F.col("y_hat") - F.col("y")) ** 2)).alias("rmse")).withColumn("model", F.lit(n)) for n, df in fits.items()]
    best = S.best_and_runner_up(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return best.select("place", "model", *r4("rmse", "gap"))


GAPS = ["y_hat", "pred_value", "log_gap", "score_raw", "cell_bias", "log_gap_debiased", "score_debiased"]


@query(O.scored(f"SELECT entity, season, age_band, value_band, cell, hit_raw, hit_rel, {q4(*GAPS)} FROM scored"))
def linear_gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(*KEY, "age_band", "value_band", "cell", "hit_raw", "hit_rel", *r4(*GAPS))


DIMENSIONS = ["position_group", "league", "age_band", "value_band"]


@query(O.scored(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS segment, {METRIC_SQL.format(v='pred_value')} FROM scored GROUP BY {d}" for d in DIMENSIONS)))
def error_breakdown_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(S.breakdown(scored(spark, sf_dir), DIMENSIONS), "dimension", "segment")


QUANTILES = ["q10", "q25", "q75", "q90"]
QUANTILE_SQL = ", ".join(f"quantile_cont(y - y_hat, 0.{q[1:]}) AS {q}" for q in QUANTILES)


@query(O.scored(f"SELECT band, n, {q4(*QUANTILES)} FROM (SELECT 'overall' AS band, count(*) AS n, {QUANTILE_SQL} FROM scored UNION ALL SELECT value_band, count(*), {QUANTILE_SQL} FROM scored GROUP BY value_band)"))
def residual_quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.residual_quantiles(scored(spark, sf_dir), "value_band", F.col("y") - F.col("y_hat")).select("band", "n", *r4(*QUANTILES))


@query(O.scored(f"""SELECT s.entity, round(pred_value * exp(coalesce(q.q10, o.q10)), 1) AS low_80, round(pred_value * exp(coalesce(q.q90, o.q90)), 1) AS high_80 FROM scored s
    LEFT JOIN (SELECT value_band AS band, {QUANTILE_SQL} FROM scored GROUP BY 1) q ON q.band = CASE WHEN pred_value < 1e6 THEN '<€1M' WHEN pred_value < 5e6 THEN '€1-5M' WHEN pred_value < 20e6 THEN '€5-20M' ELSE '€20M+' END,
    (SELECT {QUANTILE_SQL} FROM scored) o"""))
def prediction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    quantiles = S.residual_quantiles(rows, "value_band", F.col("y") - F.col("y_hat"))
    return S.value_range(rows, quantiles).select("entity", F.round("low_80", 1).alias("low_80"), F.round("high_80", 1).alias("high_80"))


# Backtest -------------------------------------------------------------------------------------------------------------

SIZES = {"top_decile": None, "top_100": 100}
MEASURES = ["missing_rate", "hit_raw", "hit_raw_ci_low", "hit_raw_ci_high", "hit_rel", "mean_log_change", "median_log_change", "mean_rel_change", "median_rel_change", "lift_raw", "lift_rel", "matched_expected_hit_raw",
            "matched_lift_raw", "matched_expected_hit_rel", "matched_lift_rel", "matched_excess_log_change", "matched_excess_rel_change", "hit_raw_missing_as_fail", "lift_raw_missing_as_fail",
            "matched_lift_raw_missing_as_fail"]


def _evaluated(spark: SparkSession, sf_dir: str, floors: list[float]) -> DataFrame:
    return B.evaluate(B.universes(scored(spark, sf_dir), floors), STRATEGIES, SIZES, ["floor"], "entity")


@query(O.rated(f"SELECT strategy, k, n_flagged, n_with_outcome, {q4(*MEASURES)} FROM evaluated", evaluated=True))
def strategy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, [0.0]).select("strategy", "k", "n_flagged", "n_with_outcome", *r4(*MEASURES))


@query(O.rated(f"SELECT floor, strategy, k, n_flagged, n_with_outcome, {q4('hit_raw', 'lift_raw', 'matched_lift_raw')} FROM evaluated", f"0.0, CAST({VALUE_FLOOR} AS DOUBLE)", evaluated=True))
def floor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, [0.0, VALUE_FLOOR]).select("floor", "strategy", "k", "n_flagged", "n_with_outcome", *r4("hit_raw", "lift_raw", "matched_lift_raw"))


@query(O.rated("""SELECT strategy, round(a, 4) AS missing_flagged, round(b, 4) AS missing_others, round(a - b, 4) + 0.0 AS difference, round(CASE WHEN se > 0 THEN (a - b) / se ELSE 0 END, 3) + 0.0 AS z
    FROM (SELECT strategy, avg(lost) FILTER (flagged) AS a, avg(lost) FILTER (NOT flagged) AS b, sqrt(avg(lost) * (1 - avg(lost)) * (1.0 / count(*) FILTER (flagged) + 1.0 / count(*) FILTER (NOT flagged))) AS se
    FROM (SELECT *, CAST(NOT has_outcome AS DOUBLE) AS lost FROM flagged WHERE k = 'top_decile') GROUP BY strategy)"""))
def missingness_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.missingness(scored(spark, sf_dir), STRATEGIES[1:], ["season"], "entity")
    return rows.select("strategy", *r4("missing_flagged", "missing_others", "difference"), (F.round("z", 3) + 0.0).alias("z"))


@query(O.rated("""SELECT strategy, outcome, count(*) AS n, round(corr(rs, ro), 4) + 0.0 AS ic, round(tanh(atanh(corr(rs, ro)) - 1.96 / sqrt(count(*) - 3)), 4) + 0.0 AS ci_low,
    round(tanh(atanh(corr(rs, ro)) + 1.96 / sqrt(count(*) - 3)), 4) + 0.0 AS ci_high FROM (
    SELECT strategy, outcome, rank() OVER (PARTITION BY strategy, outcome ORDER BY score) + (count(*) OVER (PARTITION BY strategy, outcome, score) - 1) / 2.0 AS rs,
        rank() OVER (PARTITION BY strategy, outcome ORDER BY o) + (count(*) OVER (PARTITION BY strategy, outcome, o) - 1) / 2.0 AS ro
    FROM (SELECT strategy, score, 'outcome_log_change' AS outcome, outcome_log_change AS o FROM long WHERE has_outcome UNION ALL SELECT strategy, score, 'outcome_rel_change', outcome_rel_change FROM long WHERE has_outcome)
    WHERE strategy IN ('model_raw', 'model_debiased', 'mean_reversion') AND score IS NOT NULL AND o IS NOT NULL) GROUP BY 1, 2"""))
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.rank_correlation(scored(spark, sf_dir), ["model_raw", "model_debiased", "mean_reversion"], ["outcome_log_change", "outcome_rel_change"], ["season"], "entity")
    return rows.select("strategy", "outcome", "n", *r4("ic", "ci_low", "ci_high"))


@query(O.rated("""SELECT (SELECT round((exp(quantile_cont(abs(y_hat - y), 0.5)) - 1) * 100, 4) FROM scored) AS typical_error_pct,
    round(max(hit_raw) FILTER (strategy = 'model_debiased' AND k = 'top_decile'), 4) AS hit_rate, round(max(hit_raw) FILTER (strategy = 'all'), 4) AS base_rate FROM evaluated""", evaluated=True))
def reliability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.reliability(S.error_table(scored(spark, sf_dir), []), _evaluated(spark, sf_dir, [0.0])).select(*r4("typical_error_pct", "hit_rate", "base_rate"))


@query()
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.summary({f.__name__: f(spark, sf_dir) for f in (strategy_table, floor_table, missingness_ztest, rank_ic, bootstrap_ci, error_breakdown_by_segment)})


N_BOOT, BOOT_K = 2000, 100
DRAWS = """, numbered AS (SELECT *, row_number() OVER (ORDER BY entity) - 1 AS idx FROM scored), size AS (SELECT count(*) AS n FROM numbered),
draws AS (SELECT b, j, CAST(('0x' || substr(md5('42-' || b || '-' || j), 1, 8)) AS BIGINT) % n AS pick FROM size, range(0, {n}) t(b), range(0, (SELECT n FROM size)) u(j)),
drawn AS (SELECT d.b, d.j, r.* FROM draws d JOIN numbered r ON r.idx = d.pick)"""


HEADLINE = [("model_debiased", "top_decile"), ("model_debiased", "top_100"), ("model_raw", "top_decile"), ("model_raw", "top_100"), ("young_regulars", "top_decile"), ("mean_reversion", "top_decile")]
SCORE_SQL = {"model_debiased": "log_gap_debiased", "model_raw": "log_gap", "young_regulars": "s_young_regulars", "mean_reversion": "s_mean_reversion"}
SIX = """,
scores AS (""" + " UNION ALL ".join(f"SELECT b, j, '{n}' AS strategy, {c} AS score, has_outcome, outcome_log_change, cell FROM drawn UNION ALL SELECT -1, idx, '{n}', {c}, has_outcome, outcome_log_change, cell FROM numbered" for n, c in SCORE_SQL.items()) + """),
ranked AS (SELECT *, CAST(outcome_log_change > 0 AS INT) AS rose, coalesce(avg(CAST(outcome_log_change > 0 AS INT)) OVER (PARTITION BY strategy, b, cell), 0) AS rate, avg(CAST(outcome_log_change > 0 AS INT)) OVER (PARTITION BY strategy, b) AS base,
    row_number() OVER (PARTITION BY strategy, b ORDER BY score DESC NULLS LAST, j) AS place FROM scores),
asked AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, '{k}' AS k, {'100' if k == 'top_100' else '(SELECT ceil(n / 10) FROM size)'} AS size" for n, k in HEADLINE) + """),
found AS (SELECT r.strategy, a.k, b, avg(rose) AS hit_raw, avg(rose) / avg(rate) AS matched_lift_raw FROM ranked r JOIN asked a ON a.strategy = r.strategy WHERE has_outcome AND score IS NOT NULL AND place <= a.size GROUP BY 1, 2, 3),
ends AS (SELECT strategy, k, """ + ", ".join(f"quantile_cont({m}, {q}) FILTER (b >= 0) AS {m}_{e}" for m in ("hit_raw", "matched_lift_raw") for e, q in (("low", 0.025), ("high", 0.975))) + """ FROM found GROUP BY 1, 2)
"""


REPLICATES = f""",
sampled AS (SELECT b, j, log_gap AS score, has_outcome, outcome_log_change, cell FROM drawn UNION ALL SELECT -1, idx, log_gap, has_outcome, outcome_log_change, cell FROM numbered),
r AS (SELECT *, CAST(outcome_log_change > 0 AS INT) AS rose, coalesce(avg(CAST(outcome_log_change > 0 AS INT)) OVER (PARTITION BY b, cell), 0) AS rate, avg(CAST(outcome_log_change > 0 AS INT)) OVER (PARTITION BY b) AS base,
    row_number() OVER (PARTITION BY b ORDER BY score DESC NULLS LAST, j) AS place FROM sampled),
m AS (SELECT b, avg(rose) AS hit_raw, avg(rose) / max(base) AS lift_raw, avg(rose) / avg(rate) AS matched_lift_raw FROM r WHERE has_outcome AND place <= {BOOT_K} GROUP BY b)"""


@query(O.scored("").rstrip() + DRAWS.format(n=N_BOOT) + REPLICATES + f"""
SELECT 'model_raw' AS strategy, {BOOT_K} AS k, {', '.join(f"round(max({m}) FILTER (b = -1), 4) AS {m}, round(quantile_cont({m}, 0.025) FILTER (b >= 0), 4) AS {m}_ci_low, round(quantile_cont({m}, 0.975) FILTER (b >= 0), 4) AS {m}_ci_high" for m in R.MEASURES)} FROM m""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.bootstrap_picks(scored(spark, sf_dir), [("model_raw", f"top_{BOOT_K}", BOOT_K)], "entity", N_BOOT)
    return rows.select("strategy", F.lit(BOOT_K).alias("k"), *r4(*(f"{m}{e}" for m in R.MEASURES for e in ("", "_ci_low", "_ci_high"))))


@query(O.scored("").rstrip() + DRAWS.format(n=N_BOOT) + """,
e AS (SELECT b, sqrt(avg((y_hat - y) * (y_hat - y))) - sqrt(avg((coalesce(val_last_rel, 0) - y) * (coalesce(val_last_rel, 0) - y))) AS diff FROM (SELECT b, y, y_hat, val_last_rel FROM drawn UNION ALL SELECT -1, y, y_hat, val_last_rel FROM numbered) GROUP BY b)
SELECT round(max(diff) FILTER (b = -1), 4) AS diff, round(quantile_cont(diff, 0.025) FILTER (b >= 0), 4) AS diff_ci_low, round(quantile_cont(diff, 0.975) FILTER (b >= 0), 4) AS diff_ci_high FROM e""")
def paired_bootstrap_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("last_hat", F.coalesce("val_last_rel", F.lit(0.0)))
    return R.bootstrap_rmse_difference(rows, "y", "y_hat", "last_hat", "entity", N_BOOT).select(*r4("diff", "diff_ci_low", "diff_ci_high"))


@query(O.rated("SELECT strategy, round(max(hit_raw) FILTER (k = 'top_decile'), 4) AS top_decile, round(max(hit_raw) FILTER (k = 'top_100'), 4) AS top_100 FROM evaluated WHERE strategy <> 'all' GROUP BY 1", evaluated=True))
def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir, [0.0]).where("strategy <> 'all'")
    return B.pivot_report(rows, "strategy", "k", ["top_decile", "top_100"], "hit_raw").select("strategy", *r4("top_decile", "top_100"))


@query(O.rated("", evaluated=True).rstrip() + DRAWS.format(n=N_BOOT) + SIX + """
SELECT e.strategy, e.k, round(e.hit_raw, 4) AS hit_raw, round(coalesce(x.hit_raw_low, hit_raw_ci_low), 4) + 0.0 AS ci_low, round(coalesce(x.hit_raw_high, hit_raw_ci_high), 4) AS ci_high,
    CASE WHEN x.hit_raw_low IS NOT NULL THEN 'bootstrap' ELSE 'wilson' END AS ci_kind, round(lift_raw, 4) AS lift_raw, round(e.matched_lift_raw, 4) AS matched_lift_raw, round(matched_lift_raw_low, 4) AS matched_low,
    round(matched_lift_raw_high, 4) AS matched_high FROM evaluated e LEFT JOIN ends x ON x.strategy = e.strategy AND x.k = e.k""")
def headline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies by size, with bootstrap intervals for the six rows that a report leads with, all from one job."""
    rows = scored(spark, sf_dir)
    results = B.evaluate(B.universes(rows, [0.0]), STRATEGIES, SIZES, ["floor"], "entity")
    table = B.headline(results, B.headline_bootstrap(rows, HEADLINE, SIZES, "entity", N_BOOT), ["strategy", "k"])
    return table.select("strategy", "k", *r4("hit_raw", "ci_low", "ci_high"), "ci_kind", *r4("lift_raw", "matched_lift_raw", "matched_low", "matched_high"))


@query(O.rated(f"SELECT strategy, n_flagged, {q4('missing_rate', 'hit_raw', 'hit_raw_missing_as_fail', 'lift_raw', 'lift_raw_missing_as_fail', 'matched_lift_raw', 'matched_lift_raw_missing_as_fail')} FROM evaluated WHERE k = 'top_decile'", evaluated=True))
def robustness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.robustness(_evaluated(spark, sf_dir, [0.0])).select("strategy", "n_flagged", *r4("missing_rate", "hit_raw", "hit_raw_missing_as_fail", "lift_raw", "lift_raw_missing_as_fail", "matched_lift_raw", "matched_lift_raw_missing_as_fail"))


@query(O.rated("SELECT strategy, k, n_flagged, " + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in ("hit_raw", "lift_raw", "matched_lift_raw", "mean_log_change")) + " FROM evaluated WHERE k <> 'top_100'", evaluated=True))
def tuning_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = Q.rounded(_evaluated(spark, sf_dir, [0.0]).where("k <> 'top_100'"), ["strategy", "k", "n_flagged"], ["hit_raw", "lift_raw", "matched_lift_raw", "mean_log_change"], 3)
    return shown.select("strategy", "k", "n_flagged", *((F.col(c) + 0.0).alias(c) for c in ("hit_raw", "lift_raw", "matched_lift_raw", "mean_log_change")))


@query()
def walk_forward_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flag seasons, each scored by trees and a ridge fitted on the seasons before it only: all six strategies by size."""
    return V.run_seasons(panel(spark, sf_dir), [FLAGGED - 1, FLAGGED], FEATURE_LIST, "entity")["strategies"]


FEATURE_LIST = [*FEATURES, "league", "position_group"]
N_TRIALS = 15  # besides the defaults

# Models ---------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 85) THEN p_brand WHEN p_brand IS NOT NULL THEN 'other' END AS p_brand FROM part WHERE (SELECT min(n) < 85 FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) OR true")
def category_levels_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return L.freeze_levels(parts, parts, ["p_brand"], 85)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    rows = panel(spark, sf_dir)
    return rows.where(F.col("season") <= TRAIN_LAST), rows.where(F.col("season") == FLAGGED), FEATURE_LIST


TREES: dict[tuple, str] = {}


def _trees(spark: SparkSession, sf_dir: str):
    """The boosted trees of the seasons before the flagged one, with their defaults: fitted and saved once a session and folder, then loaded."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in TREES:
        train, valid, features = _split(spark, sf_dir)
        folder = fresh_folder(spark, "trees")
        save_model(L.fit_and_score("boosted", train, valid, features)[0], folder)
        TREES[key] = folder
    return load_model(TREES[key])


@query()
def ridge_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid, features = _split(spark, sf_dir)
    return L.fit_and_score("linear", train, valid, features)[1].select(*KEY, "y", "y_hat")


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of four models on main features, and of the last value and ridge with value history, all with their defaults."""
    train, valid, features = _split(spark, sf_dir)
    sets = {"main": features, "ceiling": [*features, "val_last_rel", "val_peak_rel", "val_12m_rel"]}
    return L.compare(train, valid, sets, {"main": ["mean", "linear", "forest", "boosted"], "ceiling": ["last_value", "linear"]}).drop("fit_seconds")


@query()
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid, features = _split(spark, sf_dir)
    return L.ablate(train, valid, features, {"trend": ["prev_minutes", "l3_minutes"], "place": ["league", "position_group"]})


@query()
def holdout_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid, features = _split(spark, sf_dir)
    return L.search_params(train, valid, features, L.search_space(N_TRIALS))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid, _ = _split(spark, sf_dir)
    numeric = list(FEATURES)
    model, _, _ = L.fit_and_score("linear", train, valid, numeric)
    return L.permutation_importance(model, valid, numeric, "entity")


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to least squares on minutes and age, fitted on the seasons up to ``TRAIN_LAST``."""
    rows, minutes, age = panel(spark, sf_dir), F.col("minutes").cast("double"), F.col("age")
    both = [("mm", minutes, minutes), ("aa", age, age), ("ma", minutes, age), ("my", minutes, F.col("y")), ("ay", age, F.col("y"))]
    fit = rows.where(F.col("season") <= TRAIN_LAST).agg(*(F.covar_pop(x, z).alias(n) for n, x, z in both), F.avg(minutes).alias("mean_m"), F.avg(age).alias("mean_a"), F.avg("y").alias("mean_y"))
    fitted = rows.where(F.col("season") == FLAGGED).crossJoin(F.broadcast(fit))  # one row
    c = F.col
    det = c("mm") * c("aa") - c("ma") * c("ma")
    weights = {"minutes": (c("my") * c("aa") - c("ay") * c("ma")) / det, "age": (c("ay") * c("mm") - c("my") * c("ma")) / det}
    intercept = c("mean_y") - weights["minutes"] * c("mean_m") - weights["age"] * c("mean_a")
    return X.linear_contributions(fitted, weights, {"minutes": c("mean_m"), "age": c("mean_a")}, intercept)


WEIGHTS = """, two AS (SELECT covar_pop(minutes, minutes) AS mm, covar_pop(age, age) AS aa, covar_pop(minutes, age) AS ma, covar_pop(minutes, y) AS my, covar_pop(age, y) AS ay, avg(minutes) AS mean_m, avg(age) AS mean_a,
    avg(y) AS mean_y FROM panel WHERE season <= 1998), weights AS (SELECT *, (my * aa - ay * ma) / (mm * aa - ma * ma) AS wm, (ay * mm - my * ma) / (mm * aa - ma * ma) AS wa FROM two)"""
CONTRIBUTED = "SELECT entity, season, league, minutes, age, market_index, wm * (minutes - mean_m) AS shap_minutes, wa * (age - mean_a) AS shap_age, mean_y AS base_value FROM panel, weights WHERE season = 1999"
CONTRIBUTED_SQL = O.scored("").rstrip() + WEIGHTS + f", contributed AS ({CONTRIBUTED}), parts AS (SELECT entity, league, 'minutes' AS feature, shap_minutes AS shap FROM contributed UNION ALL SELECT entity, league, 'age', shap_age FROM contributed)\n"


@query(CONTRIBUTED_SQL + f"SELECT entity, {q4('shap_minutes', 'shap_age', 'base_value')} FROM contributed")
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contributions(spark, sf_dir).select("entity", *r4("shap_minutes", "shap_age", "base_value"))


@query()
def top_factors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contributions(spark, sf_dir)
    return rows.select("entity", X.top_factors(rows, ["minutes", "age"], 2).alias("top_factors"))


@query(CONTRIBUTED_SQL + "SELECT feature, round(avg(abs(shap)), 4) AS mean_abs_shap, round(avg(shap), 4) + 0.0 AS mean_shap, round(avg(abs(shap)) / (SELECT sum(a) FROM (SELECT avg(abs(shap)) AS a FROM parts GROUP BY feature)), 4) AS share, CASE feature WHEN 'age' THEN 'Age' ELSE 'Minutes' END AS label FROM parts GROUP BY feature")
def global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.importance(X.contributions(_contributions(spark, sf_dir), ["minutes", "age"], ["entity"])).select("feature", *r4("mean_abs_shap", "mean_shap", "share"), "label")


@query(CONTRIBUTED_SQL + """SELECT entity, CASE WHEN c > 0 AND c >= 2 * p THEN 'context' WHEN p > 0 AND p >= 2 * c THEN 'performance' ELSE 'mixed' END AS driver
    FROM (SELECT entity, sum(CASE WHEN feature = 'age' THEN greatest(shap, 0) ELSE 0 END) AS c, sum(CASE WHEN feature <> 'age' THEN greatest(shap, 0) ELSE 0 END) AS p FROM parts GROUP BY entity)""")
def driver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drivers(X.contributions(_contributions(spark, sf_dir), ["minutes", "age"], ["entity"]), ["entity"]).select("entity", "driver")


@query(CONTRIBUTED_SQL + "SELECT entity, CASE WHEN nth = 1 THEN feature ELSE 'all other' END AS feature, round(sum(shap), 4) + 0.0 AS shap FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(shap) DESC, feature) AS nth FROM parts) GROUP BY 1, 2")
def largest_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = X.contributions(_contributions(spark, sf_dir), ["minutes", "age"], ["entity"])
    return X.head_and_rest(long, ["entity"], 1).select("entity", "feature", *r4("shap"))


@query(CONTRIBUTED_SQL + "SELECT feature, round(avg(abs(shap)), 4) AS mean_abs_shap FROM parts GROUP BY feature ORDER BY avg(abs(shap)) DESC, feature LIMIT 1")
def most_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.most_important(X.contributions(_contributions(spark, sf_dir), ["minutes", "age"], ["entity"]), 1).select("feature", *r4("mean_abs_shap"))


@query()
def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of the boosted trees with their default parameters, by feature; with the base they sum to the prediction."""
    _, valid, features = _split(spark, sf_dir)
    return L.explain_trees(_trees(spark, sf_dir), valid, features, KEY)


@query()
def gain_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gain_importance(_trees(spark, sf_dir), _split(spark, sf_dir)[0])


@query()
def live_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last season scored by trees of all seasons before, with contributions and top factors, read back from where the job wrote it."""
    return V.run_live(panel(spark, sf_dir), FLAGGED, FEATURE_LIST, "entity", ["name", "target_date", "target_value", "market_index", "y"], folder=fresh_folder(spark, "live"), model=_trees(spark, sf_dir))


@query()
def saved_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's predictions by a ridge that was saved and loaded."""
    train, valid, features = _split(spark, sf_dir)
    folder = fresh_folder(spark, "model")
    save_model(L.fit_and_score("linear", train, valid, features)[0], folder)
    return L.predict(load_model(folder), valid).select(*KEY, "y_hat")


@query()
def test_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    ceiling = [*FEATURE_LIST, "val_last_rel", "val_peak_rel", "val_12m_rel"]
    candidates = {"boosted": ("boosted", FEATURE_LIST, None), "linear": ("linear", FEATURE_LIST, None), "ceiling_boosted": ("boosted", ceiling, None), "last_value": ("last_value", ceiling, None)}
    return V.run_test(panel(spark, sf_dir), FLAGGED, candidates)[0]


@query()
def predicted_band_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_intervals(panel(spark, sf_dir), FLAGGED, FEATURE_LIST, model=_trees(spark, sf_dir))


@query()
def feature_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the ridge need the trend features? The difference of errors, its interval, the decision."""
    return V.decide(panel(spark, sf_dir), FLAGGED, FEATURE_LIST, ["prev_minutes", "l3_minutes"], "entity", "linear")


# Serving --------------------------------------------------------------------------------------------------------------


@query(O.scored("""SELECT entity, CASE WHEN minutes IS NULL THEN 'unknown' ELSE format('{:,}', minutes) END AS minutes_shown, printf('%.1f years', age) AS age_shown,
    CASE WHEN changed_club IS NULL THEN 'unknown' WHEN changed_club = 1 THEN 'yes' ELSE 'no' END AS changed_shown FROM fitted WHERE season = 1999"""))
def plain_language_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).where(F.col("season") == FLAGGED)
    shown = lambda f: K.display_value(F.lit(f), F.col(f).cast("double"), F.col("market_index"))
    return rows.select("entity", shown("minutes").alias("minutes_shown"), shown("age").alias("age_shown"), shown("changed_club").alias("changed_shown"))


@query(O.world("""SELECT entity, 'Name: ' || name || chr(10) || 'Season: ' || season || '/' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') || chr(10) || 'Transfers: ' || lpad(CAST(season % 100 AS VARCHAR), 2, '0') || '/' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')
    || chr(10) || 'Group: ' || position_group || coalesce(chr(10) || 'Minutes before: ' || prev_minutes, '') AS sheet FROM panel WHERE season = 1999"""))
def fact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).where(F.col("season") == FLAGGED)
    lines_ = {"Name": F.col("name"), "Season": K.season_label(F.col("season")), "Transfers": K.transfer_season_label(F.col("season")), "Group": F.col("position_group"), "Minutes before": F.col("prev_minutes").cast("string")}
    return rows.select("entity", X.fact_sheet(lines_).alias("sheet"))


@query(O.scored(f"""SELECT row_number() OVER (ORDER BY score_debiased DESC, entity) AS rank, name, round(age, 1) AS age, round(target_value / 1e6, 2) AS value_m, round(score_debiased * 100, 1) + 0.0 AS score_pct FROM scored
    WHERE position_group = 'BUILDING' AND age BETWEEN 18 AND 35 AND target_value >= {VALUE_FLOOR} AND score_debiased IS NOT NULL ORDER BY 1 LIMIT 50"""))
def ranked_undervalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Q.undervalued(scored(spark, sf_dir), key="entity", position_group="BUILDING", min_age=18, max_age=35, min_value=VALUE_FLOOR, limit=50)
    return Q.leaderboard(best).select("rank", "name", "age", "value_m", (F.col("score_pct") + 0.0).alias("score_pct"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_name), '#0000001') OR contains(lower(c_mktsegment), '#0000001') ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search(table(spark, sf_dir, "customer"), "#0000001", ["c_name", "c_mktsegment"], "c_acctbal", "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query(O.scored("SELECT entity, name, strftime(end_date, '%Y-%m-%d') AS end_date, league, round(target_value, 1) AS target_value, round(pred_value, 1) AS pred_value FROM scored WHERE entity = (SELECT min(entity) FROM scored)"))
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    one = Q.lookup(rows, "entity", rows.agg(F.min("entity")).first()[0])
    return Q.record(one.select("entity", "name", "end_date", "league", F.round("target_value", 1).alias("target_value"), F.round("pred_value", 1).alias("pred_value")))


@query(O.world("""SELECT 'league' AS option, league AS value FROM panel GROUP BY league UNION ALL SELECT 'position_group', position_group FROM panel GROUP BY position_group
    UNION ALL SELECT 'apps_min', CAST(min(apps) AS VARCHAR) FROM panel UNION ALL SELECT 'apps_max', CAST(max(apps) AS VARCHAR) FROM panel"""))
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filter_options(panel(spark, sf_dir), ["league", "position_group"], ["apps"])


@query(O.scored("SELECT entity, name, league, position_group, round(target_value, 1) AS target_value FROM scored ORDER BY target_value DESC, entity"))
def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.listing(scored(spark, sf_dir), ["entity", "name", "league", "position_group", "target_value"], "target_value", "entity")
    return rows.withColumn("target_value", F.round("target_value", 1))


@query(O.scored("SELECT DISTINCT CAST(season AS VARCHAR) || '/' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS season_label, round(market_index, 4) AS market_index FROM scored"))
def live_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.scalars(scored(spark, sf_dir).withColumn("season_label", K.season_label(F.col("season"))), ["season_label", "market_index"]).select("season_label", *r4("market_index"))


@query(O.scored(f"SELECT 'least squares' AS model, count(*) AS players, {', '.join(f'round({e}, 3) AS {n}' for n, e in (('typical_error', 'sqrt(avg((y_hat - y) * (y_hat - y)))'), ('explained', '1 - sum((y_hat - y) * (y_hat - y)) / (count(*) * var_pop(y))')))}, round((exp(quantile_cont(abs(y_hat - y), 0.5)) - 1) * 100, 1) AS median_error_pct FROM scored"))
def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.accuracy(S.error_table(scored(spark, sf_dir), []).select(F.lit("least_squares").alias("model"), "*"), {"least_squares": "least squares"})


@query(O.scored("""SELECT entity, name, round(target_value, 1) AS target_value, round(pred_value * exp(coalesce(q.q10, o.q10)), 1) AS low_80, round(pred_value * exp(coalesce(q.q90, o.q90)), 1) AS high_80, apps, minutes, goals
    FROM scored s LEFT JOIN (SELECT value_band AS band, quantile_cont(y - y_hat, 0.1) AS q10, quantile_cont(y - y_hat, 0.9) AS q90 FROM scored GROUP BY 1) q
    ON q.band = CASE WHEN pred_value < 1e6 THEN '<€1M' WHEN pred_value < 5e6 THEN '€1-5M' WHEN pred_value < 20e6 THEN '€5-20M' ELSE '€20M+' END,
    (SELECT quantile_cont(y - y_hat, 0.1) AS q10, quantile_cont(y - y_hat, 0.9) AS q90 FROM scored) o WHERE entity = (SELECT min(entity) FROM scored)"""))
def entity_with_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's profile with its statistics and the range around its prediction."""
    rows = scored(spark, sf_dir)
    table = S.residual_quantiles(rows, "value_band", F.col("y") - F.col("y_hat"))
    one = Q.profile(rows, "entity", rows.agg(F.min("entity")).first()[0], ["name", "target_value"], ["apps", "minutes", "goals"], table)
    return one.select("entity", "name", F.round("target_value", 1).alias("target_value"), F.round("range.low_80", 1).alias("low_80"), F.round("range.high_80", 1).alias("high_80"), "stats.*")


@query(CONTRIBUTED_SQL + """SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY abs(shap) DESC, feature) AS nth, feature, CASE feature WHEN 'age' THEN 'Age' ELSE 'Minutes' END AS label, round(shap, 4) + 0.0 AS shap,
    round((exp(shap) - 1) * 100, 2) + 0.0 AS effect_pct FROM parts""")
def explain_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = X.contributions(_contributions(spark, sf_dir), ["minutes", "age"], ["entity", "market_index"])
    shown = Q.explanation(long, ["entity", "market_index"], F.col("market_index"))
    return shown.select("entity", "nth", "feature", "label", *r4("shap"), (F.round("effect_pct", 2) + 0.0).alias("effect_pct"))


@query()
def batch_predict_missing_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for rows that lack some features, by a ridge that imputes them."""
    train, valid, features = _split(spark, sf_dir)
    model, _, _ = L.fit_and_score("linear", train, valid, features)
    rows = Q.with_missing(valid.select("entity", "market_index", "minutes", "age", "league"), features, ["entity", "market_index"])
    return model.transform(rows).select("entity", "y_hat", K.to_value(F.col("y_hat"), F.col("market_index")).alias("pred_value"))
