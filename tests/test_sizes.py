"""What holds at any size: groups too large for a task, sums that don't depend on how rows are dealt, draws worked out side by side."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from vantage.operators import learners, market, ordered, resample
from vantage.sources.relations import partitions_for


def test_large_groups_go_through_segments_with_the_same_result(spark):
    rows = [(g, t, 0 if t % 3 else None) for g, n in ((1, 30), (2, 3), (None, 4)) for t in range(n)]
    events = spark.createDataFrame(rows, "g int, t int, v int").withColumn("p", F.when(F.col("v").isNotNull(), F.struct("t", (F.col("t") * 7 % 11).alias("w"))))
    form = lambda **a: sorted(map(str, ordered.carried(events, ["g"], ["t"], "p", "last", "next", ("w", "most"), **a).select("g", "t", "last", "next", "most").collect()))
    assert ordered.large_groups(events.select("g"), ["g"]) is None
    assert {r._group.g for r in ordered.large_groups(events.select("g"), ["g"], 3).collect()} == {1, None}
    assert form() == form(large=3) == form(large=0) == form(segments=5)


def test_the_index_has_the_same_bits_however_rows_are_dealt(spark):
    rows = spark.range(20_000).select((F.lit(1e3) + F.col("id") * 7919 % 99_991).cast("double").alias("v"))
    means = {rows.repartition(n, F.xxhash64("v", F.lit(n))).agg(market.exact_mean(F.ln("v"))).first()[0] for n in (1, 3, 7, 16)}
    plain = rows.agg(F.avg(F.ln("v"))).first()[0]
    assert len(means) == 1 and abs(means.pop() - plain) < 1e-11


def test_draws_side_by_side_are_those_of_md5():
    for n in (1, 10, 1001, 20_001):
        for b in (0, 1999):
            assert resample.drawn(n, 42, b).tolist() == [int(hashlib.md5(f"42-{b}-{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]


def test_partitions_grow_with_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with partitions_for(spark, 1000, each=10):
        assert spark.conf.get(name) == "100"
    assert spark.conf.get(name) == before


def test_metrics_predict_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def slow(x: float) -> float:
        calls.add(1)
        return x + 0.5

    rows = spark.range(40).select(F.col("id").cast("double").alias("y"), F.lit(1.0).alias("market_index"), F.lit(9.0).alias("target_value"))
    scored = rows.withColumn("y_hat", F.udf(slow, "double").asNondeterministic()("y"))
    assert learners.metrics_of(scored).first().mae == 0.5 and calls.value == 40


def test_models_beside_each_other_are_those_fitted_alone(spark):
    rows = spark.range(300).select(F.col("id").cast("double").alias("m"), (F.col("id") * 2.0 + F.col("id") % 3).alias("y"), F.lit(1.0).alias("market_index"), F.lit(9.0).alias("target_value"), F.col("id").cast("double").alias("val_last_rel"))
    got = {(r.kind, r.model): round(r.rmse, 6) for r in learners.compare(rows, rows, {"main": ["m"]}, {"main": ["mean", "linear", "last_value"]}).collect()}
    alone = {("main", n): round(learners.metrics_of(learners.fit_and_score(n, rows, rows, ["m"])[1]).first().rmse, 6) for n in ("mean", "linear", "last_value")}
    assert got == alone


def test_a_fit_of_a_forest_holds_few_trees_and_their_mean_is_over_all(spark):
    """A row's draws and nodes are held for the trees of one fit: 400 trees at once left memory. A part of one tree counts as one tree of 26."""
    fits = [s for s in learners.build("forest", ["m"], []).getStages() if hasattr(s, "getNumTrees")]
    assert sum(s.getNumTrees() for s in fits) == 400 and max(s.getNumTrees() for s in fits) <= 25 and len({s.getSeed() for s in fits}) == len(fits)
    assert all(s.getCacheNodeIds() for s in fits)
    rows = spark.createDataFrame([(i, float(i % 7), "x" if i % 2 else "y", 0.3 * (i % 7) + (i % 2)) for i in range(120)], "id int, m double, c string, y double")
    model, scored, _ = learners.fit_and_score("forest", rows, rows, ["m", "c"], {"numTrees": 26})
    assert [len(m.trees) for m in learners.trees_of(model)] == [25, 1] and scored.columns == [*rows.columns, "y_hat"]
    got = {r.id: r for r in learners.explain_trees(model, rows, ["m", "c"], ["id"]).collect()}
    assert len(got) == 120 and all(abs(r.shap_m + r.shap_c + r.base_value - r.y_hat) < 1e-9 for r in got.values())
    assert {r.id: r.y_hat for r in scored.collect()} == {i: r.y_hat for i, r in got.items()}
    assert {r.feature for r in learners.gain_importance(model, rows).collect()} == {"m", "c"}
