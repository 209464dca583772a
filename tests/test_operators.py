"""As-of joins against brute force, cleaning rules, scores, backtest measures, audits, explanations and serving."""

import math
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantage.functions import columns as K
from vantage.functions import config as C
from vantage.operators import asof, audit, backtest, explain, learners, resample, scoring, serve
from vantage.operators.cleaning import clean_appearances, clean_transfers, clean_valuations
from vantage.sources.relations import RELATIONS, read_panel, write_panel, write_report

DAY = date(2020, 1, 1)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), min_size=1, max_size=8),
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 5)), min_size=1, max_size=12), st.booleans(), st.sampled_from([None, 5]),
)
def test_asof_backward_forms_agree_with_brute_force(spark, probes, series, strict, lookback):
    left = spark.createDataFrame([(i, k, DAY + timedelta(d)) for i, (k, d) in enumerate(probes)], "id int, k int, at date")
    right = spark.createDataFrame([(k, DAY + timedelta(d), v) for k, d, v in series], "k int, ts date, v int")
    want = {}
    for i, (k, d) in enumerate(probes):
        fits = [(e, v) for kk, e, v in series if kk == k and (e < d if strict else e <= d) and (lookback is None or e > d - lookback)]
        want[i] = max(fits)[1] if fits else None
    for method in ("window", "range"):
        got = {r.id: r.v for r in asof.asof_backward(left, right, ["k"], "at", "ts", ["v"], strict, lookback, method).collect()}
        assert got == want, method


def test_nearest_prefers_the_later(spark):
    probes = spark.createDataFrame([(1, DAY)], "k int, at date")
    series = spark.createDataFrame([(1, DAY - timedelta(3), 10), (1, DAY + timedelta(3), 20), (1, DAY + timedelta(40), 30)], "k int, ts date, v int")
    pick = lambda **a: [r.v for r in asof.asof_nearest(probes, series, ["k"], F.col("at"), "ts", {"v": "v"}, **a).collect()]
    assert pick(within_days=10) == [20] and pick(within_days=10, prefer_later=False) == [10] and pick(within_days=2) == []


def test_cleaning_rules(spark):
    rows = [(1, 7, 1, DAY, "GB1", None, -1, -1, 2, 200), (1, 7, 1, DAY, "GB1", 1, 0, 3, 0, 90)]
    one = clean_appearances(spark.createDataFrame(rows, RELATIONS["appearances"][0])).collect()
    assert [(r.minutes, r.goals, r.assists, r.yellow_cards, r.red_cards) for r in one] == [(130, 0, 2, 0, 0)]
    values = [(7, DAY, 0, "GB1"), (7, DAY, 5, "GB1"), (7, DAY, 9, "GB1")]
    assert [r.value for r in clean_valuations(spark.createDataFrame(values, RELATIONS["player_valuations"][0])).collect()] == [9]
    moves = [(7, DAY, "19/20", 1, 2, -5.0), (7, DAY, "19/20", 1, 1, 3.0), (7, DAY, "19/20", None, 2, 0.0), (7, DAY, "19/20", None, None, 1.0)]
    assert [r.fee for r in clean_transfers(spark.createDataFrame(moves, RELATIONS["transfers"][0])).orderBy("fee").collect()] == [None, 0.0]


def test_labels_and_bands(spark):
    r = spark.range(1).select(
        K.season_label(F.lit(2009)).alias("a"), K.transfer_season_label(F.lit(1999)).alias("b"), K.band(F.lit(21.0), C.AGE_BANDS).alias("c"), K.band(F.lit(120), C.AGE_BANDS).alias("d"),
        K.band(F.lit(3e7), C.VALUE_BANDS).alias("e"), K.ratio(F.lit(1), F.lit(0)).alias("f"), K.money(F.lit(-1_240_000.0)).alias("g"), K.percent(F.lit(0.256), True, 1).alias("h"),
        K.compact_money(F.lit(None).cast("double")).alias("i"), K.normalize_position(F.lit(" SWEEPER ")).alias("j"), K.normalize_position(F.lit("missing")).alias("k"),
    ).first()
    assert tuple(r) == ("2009/10", "99/00", "21-24", None, "€20M+", None, "−€1.2M", "+25.6%", "–", "Centre-Back", None)


def test_display_values(spark):
    cases = [("league_index_rel", -0.85, None, "43% of market average"), ("club_fees_in_rel", 0.65, math.log(1.7e6), "€1.1M"), ("club_in_europe", 1.0, None, "yes"), ("start_share", 0.5, None, "50%"),
             ("age", 21.26, None, "21.3 years"), ("height_cm", 184.0, None, "184 cm"), ("minutes_delta", 1200.0, None, "+1,200 minutes"), ("minutes", 2345.0, None, "2,345"), ("club_ppg", 1.234, None, "1.23"), ("age", None, None, "unknown")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, v double, idx double, want string")
    for r in rows.select("want", K.display_value(F.col("f"), F.col("v"), F.col("idx")).alias("got")).collect():
        assert r.got == r.want


SCORED = "player_id int, s_model_raw double, s_all double, cell string, has_outcome boolean, outcome_log_change double, outcome_rel_change double, hit_raw int, hit_rel int, target_value double, season int"


@pytest.fixture(scope="module")
def ten(spark):
    rows = []
    for i in range(10):
        change = None if i in (3, 8) else (0.1 if i % 2 == 0 else -0.2)
        hit = None if change is None else int(change > 0)
        rows.append((i, None if i == 9 else float(10 - i), 0.0, "a" if i < 5 else "b", change is not None, change, change, hit, hit, 1e6 * (i + 1), 2024))
    return spark.createDataFrame(rows, SCORED).persist()


def test_evaluation_by_hand(ten):
    rows = {(r.strategy, r.k): r for r in backtest.evaluate(ten, ["all", "model_raw"], {"top_decile": None, "top_4": 4}, ["season"], "player_id").collect()}
    every, four = rows["all", "all"], rows["model_raw", "top_4"]
    assert (every.n_flagged, every.n_with_outcome, every.hit_raw, every.lift_raw, every.matched_lift_raw) == (10, 8, 0.5, 1.0, 1.0)
    assert (rows["model_raw", "top_decile"].n_flagged, four.n_flagged, four.n_with_outcome, four.missing_rate) == (1, 4, 3, 0.25)
    assert four.hit_raw == pytest.approx(2 / 3) and four.matched_expected_hit_raw == pytest.approx(3 / 4) and four.hit_raw_missing_as_fail == 0.5
    assert four.matched_lift_raw == pytest.approx((2 / 3) / 0.75) and four.lift_raw_missing_as_fail == pytest.approx(0.5 / 0.4)
    nine = backtest.evaluate(ten, ["model_raw"], {"top_10": 10}, ["season"], "player_id").first()
    assert nine.n_flagged == 9  # a row without a score is never picked


def test_missingness_and_ranks(ten):
    m = backtest.missingness(ten, ["model_raw"], ["season"], "player_id", 4).first()
    assert (m.missing_flagged, m.missing_others) == (0.25, pytest.approx(1 / 6))
    assert m.p_value == pytest.approx(math.erfc(abs(m.z) / math.sqrt(2)), abs=1e-6)
    r = backtest.rank_correlation(ten, ["model_raw"], ["outcome_log_change"], ["season"], "player_id").first()
    assert r.n == 7 and r.ci_low < r.ic < r.ci_high


def test_bootstrap_point_equals_evaluation(ten):
    b = resample.bootstrap_picks(ten, [("model_raw", "top_4", 4)], "player_id", n_boot=30).first()
    e = backtest.evaluate(ten, ["model_raw"], {"k": 4}, ["season"], "player_id").first()
    assert (b.hit_raw, b.matched_lift_raw) == (pytest.approx(e.hit_raw), pytest.approx(e.matched_lift_raw)) and b.hit_raw_ci_low <= b.hit_raw <= b.hit_raw_ci_high
    d = resample.bootstrap_rmse_difference(ten.withColumns({"y": F.lit(0.0), "p": F.lit(1.0), "q": F.lit(3.0)}), "y", "p", "q", "player_id", 10).first()
    assert tuple(d) == (-2.0, -2.0, -2.0)


def test_gap_scores(spark):
    rows = [("GB1", 22.0, 0.0, 0.5, 1.0)] * 40 + [("GB1", 27.0, 0.0, -0.5, 1.0)] * 10 + [("GB1", 120.0, 0.0, 0.5, 1.0)]
    df = scoring.score_frame(scoring.add_segments(spark.createDataFrame(rows, "league string, age double, y double, y_hat double, market_index double").withColumn("target_value", F.lit(1.0))))
    got = {r.age: r for r in df.collect()}
    assert got[22.0].cell_bias == pytest.approx(0.5 * 40 / 60) and got[27.0].cell_bias == pytest.approx(-0.5 * 10 / 30)
    assert got[120.0].cell_bias is None and got[120.0].score_debiased is None and got[22.0].pred_value == pytest.approx(math.exp(1.5))


def test_audit_names_the_rule(spark):
    rows = spark.createDataFrame([(1, 2014, 5), (1, 2014, 5), (2, 2014, None)], "player_id int, season int, x int")
    assert audit.validate_panel(rows).where("rule like 'missing column%'").count() > 10
    with pytest.raises(ValueError, match="missing column"):
        audit.assert_valid(rows)
    bad = {r.rule: r.n_bad for r in audit.count_failures(rows, audit.range_rules({"x": (6, 9)}) | {"none": F.col("x").isNull()}).collect()}
    assert bad == {"x below 6": 2, "x above 9": 0, "none": 1}
    diff = audit.panel_diff(rows.dropDuplicates(), rows.dropDuplicates().withColumn("x", F.col("x") + 1), ["player_id", "season"], ["x"]).first()
    assert diff.n_diff == 1 and audit.only_in(rows, rows.where("player_id = 1"), ["player_id"]).count() == 1


def test_contributions_add_up(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0), (2, 20.0, None)], "id int, minutes double, age double")
    coef, means = {"minutes": 0.1, "age": -0.5}, {"minutes": 15.0, "age": 3.0}
    got = explain.linear_contributions(df, coef, means, 1.0)
    r = {x.id: x for x in got.collect()}
    assert r[1].shap_minutes + r[1].shap_age + r[1].base_value == pytest.approx(1.0 + 0.1 * 10 - 0.5 * 2) and r[2].shap_age == 0
    long = explain.contributions(got, ["minutes", "age"], ["id"])
    assert explain.importance(long).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert {x.id: x.driver for x in explain.drivers(long, ["id"]).collect()} == {1: "context", 2: "performance"}
    assert got.select(explain.top_factors(got, ["minutes", "age"], 1)).first()[0].startswith('[{"feature":')
    assert explain.head_and_rest(long, ["id"], 1).where("feature = 'all other'").count() == 2


def test_serving(spark):
    df = spark.createDataFrame([(1, "Ann (A)", "GB1", 20.0, 1e6, 0.5), (2, "Bob", "ES1", 30.0, 1e5, 0.9), (3, "Cy", "GB1", 25.0, 2e6, None)], "player_id int, name string, league string, age double, target_value double, score_debiased double")
    assert [(r.player_id, r["rank"]) for r in serve.undervalued(df).collect()] == [(1, 1)]
    assert [r.player_id for r in serve.undervalued(df, min_value=0).collect()] == [2, 1]
    assert [r.player_id for r in serve.search(df, "(a", ["name"], "target_value", "player_id").collect()] == [1]
    with pytest.raises(KeyError):
        serve.lookup(df, "player_id", 9)
    with pytest.raises(ValueError, match="unknown"):
        serve.with_missing(df, ["age"], ["player_id"])
    assert serve.league_names(df.withColumn("league_name", F.lit("x"))).first().league_name == "Premier League (England)"


def test_levels_and_baselines(spark):
    train = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 2.0)] * 5 + [("rare", 3.0)], "c string, y double")
    seen = spark.createDataFrame([("a",), ("rare",), ("new",), (None,)], "c string")
    assert sorted(r.c or "-" for r in learners.freeze_levels(train, seen, ["c"], 5).collect()) == ["-", "a", "other", "other"]
    rows = spark.createDataFrame([(0.4,), (None,)], "val_last_rel double")
    assert [r.y_hat for r in learners.last_value_baseline(train, rows).collect()] == [0.4, pytest.approx(18 / 11)]


def test_models_and_tree_contributions(spark):
    rows = [(i, float(i % 7), "x" if i % 2 else "y", 0.3 * (i % 7) + (i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "player_id int, m double, c string, y double").withColumns({"market_index": F.lit(1.0), "target_value": F.exp(F.col("y") + 1)})
    model, scored, _ = learners.fit_and_score("linear", df, df, ["m", "c"])
    assert learners.metrics_of(scored).first().rmse < 0.2
    boosted, scored, _ = learners.fit_and_score("boosted", df, df, ["m", "c"], {"maxIter": 5})
    assert scored.columns == [*df.columns, "y_hat"]
    for r in learners.explain_trees(boosted, df, ["m", "c"], ["player_id"]).collect():
        assert r.shap_m + r.shap_c + r.base_value == pytest.approx(r.y_hat, abs=1e-8)
    with pytest.raises(ValueError):
        learners.build("other", ["m"], [])


def test_sinks(spark, tmp_path, ten):
    write_panel(ten, str(tmp_path / "p"))
    assert read_panel(spark, str(tmp_path / "p"), 2024).count() == 10 and read_panel(spark, str(tmp_path / "p"), 2023).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        write_panel(ten, str(tmp_path / "p"))
    write_panel(ten, str(tmp_path / "p"), overwrite=True)
    write_report(ten, str(tmp_path / "r"))
