"""The same operators on the star schema of orders: customers as entities, order totals as their value series, line items as
activity, suppliers as clubs, regions as leagues, years as seasons."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import config as C
from ..operators import activity as A
from ..operators import market as M
from ..operators import scoring as S
from ..operators.cleaning import clean_series, keep_first
from ..sources.relations import partitions_for, stored

KEY = ["entity", "season"]
MIN_MINUTES = 20
TRAIN_LAST, FLAGGED = 1998, 1999
FEATURES = ("minutes", "apps", "goals", "league_minutes", "n_clubs_season", "prev_minutes", "l3_minutes", "age")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_lines(table(spark, sf_dir, "lineitem"))


def first_lines(raw: DataFrame) -> DataFrame:
    return keep_first(raw, ["l_orderkey", "l_linenumber"], F.desc("l_quantity"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_totalprice") * 100).alias("value"))
    return clean_series(raw, "entity", "date", "value")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clubs = t("supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("league"))
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("entity"))
    # dealt by order, so that finding a line's first row and joining its order take one shuffle
    raw = t("lineitem").where("l_orderkey is not null").repartition("l_orderkey")
    rows = first_lines(raw).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(clubs, F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.col("l_shipdate").cast("date")
    return rows.select(
        "entity", F.year(day).cast("bigint").alias("season"), "league", F.col("l_suppkey").alias("club_id"), day.alias("date"), F.col("l_quantity").cast("bigint").alias("minutes"),
        F.col("l_linenumber").cast("bigint").alias("goals"), (F.col("l_returnflag") != "R").alias("is_league"),
    )


def seasons(act: DataFrame) -> DataFrame:
    return A.season_calendar(act, club="club_id")


def facts(act: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row an entity and season: main affiliation, its league's season, totals up to that season's end.

    Activity is summed by entity, season, club and how many of the season's ends (one a league) lie before it: from these sums come
    the main affiliation and the totals, so that activity itself is shuffled once.
    """
    c = F.col
    ends = calendar.groupBy("season").agg(F.sort_array(F.collect_set("end_date")).alias("_ends"))  # a row a season, a date a league
    dated = act.join(F.broadcast(ends), "season").withColumn("_late", F.when(c("date").isNotNull(), F.size(F.filter("_ends", lambda e: e < c("date")))))
    sums = dated.groupBy(*KEY, "league", "club_id", "_late").agg(
        F.count(F.lit(1)).alias("_apps"), F.sum("minutes").alias("_minutes"), F.sum("goals").alias("_goals"), F.sum(F.when(c("is_league"), c("minutes"))).alias("_own"), F.max("date").alias("_last"),
    ).repartition(*KEY)
    named = A.main_affiliation(sums, KEY, ["league", "club_id"], "_minutes", c("_apps"))
    spans = calendar.join(F.broadcast(ends), "season").withColumn("_at", F.array_position("_ends", c("end_date")) - 1).drop("_ends")
    main = named.join(F.broadcast(spans), ["league", "season"])  # a row a league and season
    told = ["league", "club_id", *(x for x in calendar.columns if x not in ("league", "season"))]
    parts = sums.drop("league").withColumnRenamed("club_id", "_club").join(main, KEY).where("_late <= _at")
    return parts.groupBy(*KEY, *told).agg(
        F.sum("_apps").alias("apps"), F.sum("_minutes").alias("minutes"), F.sum("_goals").alias("goals"), F.coalesce(F.sum("_own"), F.lit(0)).alias("league_minutes"),
        F.countDistinct("_club").alias("n_clubs_season"), F.max("_last").alias("last_app"),
    )


def population(rows: DataFrame) -> DataFrame:
    eligible = rows.where(F.col("minutes") >= MIN_MINUTES).select("entity", (F.col("season") + 1).alias("season"), "league")
    return eligible.withColumn("asof_date", F.make_date(F.col("season").cast("int"), F.lit(7), F.lit(1)))


class World:
    """The intermediate results that several queries share. What several of them read is stored once in the shared folder.

    ``World.of`` gives the same object for the same session, folder and cut-off: for input that doesn't change meanwhile.
    """

    _known: dict[tuple, World] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, cutoff: str | None = None) -> World:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, cutoff)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir, cutoff)
        return cls._known[key]

    def __init__(self, spark: SparkSession, sf_dir: str, cutoff: str | None = None):
        bound = (lambda df: df if cutoff is None else df.where(F.col("date") <= F.lit(cutoff).cast("date")))
        self.spark, self.rows = spark, table(spark, sf_dir, "lineitem").count()  # from the files' footers
        with partitions_for(spark, self.rows):
            self.activity, self.values = stored(bound(activity(spark, sf_dir))), stored(bound(values(spark, sf_dir)))
            self.calendar = stored(seasons(self.activity))
            self.facts = stored(facts(self.activity, self.calendar))
            self.index = stored(M.market_index(population(self.facts), self.values, "entity", "league"))
            self.dated = stored(M.targets(self.facts, self.values, "entity", keep=("start_date", "end_date"), unique=True))
        self.targets = self.dated.drop("start_date", "end_date")
        self.customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("position_group"))

    def cutoffs(self) -> DataFrame:
        return self.dated.withColumn("cutoff", F.least("end_date", F.date_sub("target_date", 1)))

    def history(self) -> DataFrame:
        return M.value_history(self.cutoffs(), self.values, "entity")

    def outcomes(self) -> DataFrame:
        return M.outcomes(self.targets, self.values, "entity", unique=True)

    @cached_property
    def panel(self) -> DataFrame:
        """One row an entity and complete season with enough activity, a target and an index."""
        with partitions_for(self.spark, self.rows):
            return self._panel()

    def _panel(self) -> DataFrame:
        c, relative = F.col, lambda x: F.ln(F.col(x)) - F.col("market_index")
        carried = ["club_id", "league", "minutes"]
        rows = (
            self.facts.where(c("complete") & (c("minutes") >= MIN_MINUTES)).join(self.targets, KEY).join(self.customers, "entity")
            .join(A.previous_season(self.facts, "entity", "season", carried), KEY, "left")
            .join(A.trailing(self.facts, "entity", "season", {"minutes": "l3_minutes"}, "l3_seasons"), KEY, "left")
            .join(self.index.where(c("league") == M.ALL).select("season", c("asof_date").alias("index_asof_date"), c("idx").alias("market_index")), "season")
            .join(self.index.where(c("league") != M.ALL).select("season", "league", c("idx").alias("league_index")), ["season", "league"], "left")
            .join(M.index_at(self.index, "index_at_target", 1), "season", "left").join(M.index_at(self.index, "index_at_future", 2), "season", "left")
            .join(self.history(), KEY, "left").join(self.outcomes(), KEY, "left")
        )
        change = F.ln(c("future_value") / c("target_value"))
        return stored(rows.select(
            *KEY, "name", "position_group", "league", "club_id", "start_date", "end_date", "target_date", "target_value", (16 + c("entity") % 25).cast("double").alias("age"),
            "apps", "minutes", "goals", "league_minutes", "n_clubs_season", K.ratio(c("goals") * 90.0, c("minutes")).alias("goals_per90"),
            F.when(c("prev_seen"), (c("prev_club_id") != c("club_id")).cast("int")).alias("changed_club"), "prev_minutes", (c("minutes") - c("prev_minutes")).alias("minutes_delta"),
            "l3_seasons", "l3_minutes", "market_index", (c("league_index") - c("market_index")).alias("league_index_rel"), relative("target_value").alias("y"),
            relative("val_last").alias("val_last_rel"), relative("val_season_start").alias("val_season_start_rel"), relative("val_peak").alias("val_peak_rel"),
            relative("val_12m").alias("val_12m_rel"), F.datediff("end_date", "val_hist_date").alias("days_since_val_last"),
            c("last_update_log_change").alias("bt_last_update_log_change"), c("future_value").alias("outcome_future_value"), c("future_date").alias("outcome_future_date"),
            change.alias("outcome_log_change"), (change - (c("index_at_future") - c("index_at_target"))).alias("outcome_rel_change"),
            "last_app", "val_hist_date", "val_cutoff", "index_asof_date",
        ))

    @cached_property
    def scored(self) -> DataFrame:
        """The flagged season's rows with gaps, peers' bias, strategy scores, outcome flags and cells."""
        fitted = with_fit(self.panel).where(F.col("season") == FLAGGED)
        return stored(S.strategies(S.score_frame(S.add_segments(fitted))))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).panel


def with_fit(rows: DataFrame, feature: str = "minutes", y: str = "y") -> DataFrame:
    """Rows with y_hat by least squares on one feature, fitted on the seasons up to ``TRAIN_LAST``."""
    fit = rows.where(F.col("season") <= TRAIN_LAST).agg(F.regr_slope(y, feature).alias("slope"), F.regr_intercept(y, feature).alias("intercept"), F.avg(feature).alias("mean"))
    return rows.crossJoin(F.broadcast(fit)).withColumn("y_hat", F.col("intercept") + F.col("slope") * F.col(feature))  # one row


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return World.of(spark, sf_dir).scored


STRATEGIES = ["all", "model_raw", "model_debiased", "young_regulars", "mean_reversion"]
VALUE_FLOOR = C.VALUE_FLOOR * 20
