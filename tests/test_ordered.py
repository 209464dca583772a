"""Places, ranks, carried values and order statistics over segments and brackets, against plain Python."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from vantage.operators import asof, market, ordered, select


@pytest.fixture(scope="module")
def scores(spark):
    """One group has two thirds of the rows, and a value of it a third."""
    draw = random.Random(1)
    rows = [(i, draw.choice(["hot", "hot", "hot", "b", None]), draw.choice([7.0, 7.0, None, -0.0, 0.0, draw.gauss(0, 9), 10.0 ** draw.randint(-30, 30)])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(4).cache()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, []).append(r)
    return out


@pytest.mark.parametrize("segments", [40])
def test_positions(scores, segments):
    got = groups(ordered.positions(scores, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], segments=segments))
    for rows in got.values():
        want = sorted(rows, key=lambda r: (r.v is None, -(r.v or 0), r.id))
        assert [r.position for r in want] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("segments", [1, 40])
def test_average_ranks(scores, segments):
    """With 40 segments the run of one value lies in several of them."""
    got = groups(ordered.average_ranks(scores, ["g"], "v", "id", "rank", segments))
    assert set(got) == {"hot", "b", None}
    for rows in got.values():
        values = sorted(r.v + 0.0 for r in rows)
        place = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in set(values)}
        assert all(r.rank == place[r.v + 0.0] for r in rows)


def test_one_run_over_all_segments(spark):
    df = spark.range(500).select("id", F.lit(1.0).alias("v"))
    assert {r.rank for r in ordered.average_ranks(df, [], "v", "id", "rank", 9).collect()} == {250.5}


@pytest.fixture(scope="module")
def walks(spark):
    """A hot entity with most dates and probes, entities without probes or without values, nulls."""
    draw, start = random.Random(2), date(2000, 1, 1)
    day = lambda: start + timedelta(days=draw.randint(0, 900))
    series = [(draw.choice(["hot"] * 6 + ["b", "c", None]), draw.choice([day(), day(), day(), None]), draw.choice([float(draw.randint(1, 9)), None])) for _ in range(900)]
    probes = [(i, draw.choice(["hot"] * 6 + ["b", "d", None]), draw.choice([day(), day(), day(), None])) for i in range(400)]
    return spark.createDataFrame(probes, "id long, k string, at date").repartition(3), spark.createDataFrame(series, "k string, ts date, v double").repartition(3)


@pytest.mark.parametrize("later", [True, False])
@pytest.mark.parametrize("days", [3, 400])
def test_nearest_forms_agree(walks, later, days):
    probes, series = walks
    form = lambda m: sorted(map(tuple, asof.asof_nearest(probes, series, ["k"], F.col("at"), "ts", {"v": "near", "ts": "when"}, days, later, m).collect()), key=str)
    want = {}
    known = [r for r in series.collect() if r.ts and r.k]
    for p in probes.collect():
        found = [(abs((s.ts - p.at).days), (s.ts > p.at) != later, s.v is not None, s.v or 0, s) for s in known if p.at and s.k == p.k and abs((s.ts - p.at).days) <= days]
        if found:
            want[p.id] = min(found, key=lambda x: x[:4])[4]
    assert form("range") == form("segments") == sorted(((p.id, p.k, p.at, want[p.id].v, want[p.id].ts) for p in probes.collect() if p.id in want), key=str)


@pytest.mark.parametrize("strict", [True, False])
def test_backward_forms_agree(walks, strict):
    probes, series = walks
    form = lambda m: sorted(map(tuple, asof.asof_backward(probes, series, ["k"], "at", "ts", ["v"], strict, 60, m).collect()), key=str)
    assert form("window") == form("segments") == form("range")
    with pytest.raises(ValueError, match="other"):
        form("other")


def test_a_hot_entity_lies_in_many_segments(walks):
    _, series = walks
    rows = ordered.segmented(series, ["k"], [F.col("ts")], 16)
    assert rows.where("k = 'hot'").select("_seg").distinct().count() >= 8
    ends = rows.where("k = 'hot'").groupBy("_seg").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a is not null").orderBy("_seg").collect()
    assert all(x.b <= y.a for x, y in zip(ends, ends[1:], strict=False))


def test_history_forms_agree(spark, walks):
    _, series = walks
    clean = series.where("k is not null and ts is not null and v is not null").groupBy("k", "ts").agg(F.max("v").alias("v")).withColumnsRenamed({"k": "e", "ts": "date", "v": "value"})
    cuts = spark.createDataFrame([(k, s, date(2000 + s, 3, 1), date(2000 + s, 12, 1)) for k in ("hot", "b", "x") for s in range(-1, 4)], "e string, season int, start_date date, cutoff date")
    form = lambda m: sorted(map(tuple, market.value_history(cuts, clean, "e", method=m).collect()))
    assert form("window") == form("segments") and len(form("segments")) > 5


@pytest.fixture(params=[(256, 4096), (3, 5)], ids=["usual", "many rounds"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(select, "BINS", request.param[0])
    monkeypatch.setattr(select, "SMALL", request.param[1])


def test_order_statistics(spark, scores, sizes):
    wanted = scores.select("g").distinct().select("g", F.explode(F.array(*map(F.lit, (0, 1, 2, 50, 400, 900, 99_999)))).alias("position"))
    if select.BINS == 3:
        scores = scores.where("abs(v) < 1e9 and id % 4 = 0")
    got = {(r.g, r.position): r.value for r in select.order_statistics(scores, ["g"], "v", wanted).collect()}
    want = {}
    for g, rows in groups(scores.where("v is not null")).items():
        values = sorted(r.v for r in rows)
        want |= {(g, p): values[p - 1] for p in (1, 2, 50, 400, 900) if p <= len(values)}
    assert got == want


def test_quantiles(spark, scores, sizes):
    """As Spark's own exact percentile, which holds a group's values in one task."""
    rows = scores.where("v is null or (abs(v) < 1e6 and id % 3 = 0)") if select.BINS == 3 else scores
    asked = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: r for r in select.quantiles(rows, ["g"], "v", asked).collect()}
    for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, asked.values()))).alias("q")).collect():
        assert got[r.g].n == r.n and [got[r.g][x] for x in asked] == pytest.approx(r.q, rel=1e-12)
    none = select.quantiles(rows.where("v is null"), ["g"], "v", {"x": 0.5}).collect()
    assert all(r.n == 0 and r.x is None for r in none)
    whole = select.quantiles(rows, [], "v", {"x": 0.5}).first()
    assert whole.x == pytest.approx(rows.agg(F.percentile("v", F.lit(0.5))).first()[0])
    assert select.quantiles(rows.limit(0), [], "v", {"x": 0.5}).first().asDict() == {"n": 0, "x": None}


def test_values_that_do_not_count(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, float("inf")), (1, 2.0), (1, None), (1, 4.0)], "g int, v double")
    assert select.quantiles(df, ["g"], "v", {"x": 0.5}).first().asDict() == {"g": 1, "n": 2, "x": 3.0}


def test_top_k(spark, scores, sizes):
    sizes_ = spark.createDataFrame([(g, n, k) for g in ("hot", "b", None) for n, k in (("none", 0), ("one", 1), ("some", 37), ("ties", 333), ("all", 10**6))], "g string, label string, size long")
    got = {}
    for r in select.top_k(scores, ["g"], "v", "id", sizes_).collect():
        got.setdefault((r.g, r.label), []).append(r)
    assert len(got) == 15
    for (_, label), rows in got.items():
        k = {"none": 0, "one": 1, "some": 37, "ties": 333, "all": 10**6}[label]
        best = sorted((r for r in rows if r.v is not None), key=lambda r: (-r.v, r.id))[:k]
        assert {r.id for r in rows if r.chosen} == {r.id for r in best}


def test_bootstrap_forms_agree(spark):
    """Tasks that hold the rows give what joined draws give, with ties, missing scores, missing outcomes and sizes beyond the rows."""
    from vantage.operators import resample

    draw = random.Random(8)
    rows = [(i, draw.random() < 0.8, draw.choice([0.5, -0.5, None]), draw.choice("abc"), draw.choice([1.0, 2.0, None, draw.random()]), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, has_outcome boolean, outcome_log_change double, cell string, s_one double, s_flat double").withColumn("has_outcome", F.col("has_outcome") & F.col("outcome_log_change").isNotNull())
    sizes = [("one", "few", 5), ("one", "many", 200), ("flat", "some", 13)]
    form = lambda held: {(r.strategy, r.k): [x and round(x, 12) for x in tuple(r)[2:]] for r in resample.bootstrap_picks(df, sizes, "id", 50, 3, held).collect()}
    assert form(True) == form(False) and len(form(True)) == 3
    assert resample.bootstrap_picks(df.limit(0), sizes, "id", 5).count() == 0
    pairs = df.withColumns({"y": F.lit(0.0), "p": F.col("id") * 0.1, "q": F.col("id") * 0.2 + 1})
    a, b = (resample.bootstrap_rmse_difference(pairs, "y", "p", "q", "id", 40, 3, held).first() for held in (True, False))
    assert tuple(a) == pytest.approx(tuple(b)) and a.diff_ci_low < a.diff < a.diff_ci_high
    assert tuple(resample.bootstrap_rmse_difference(pairs.limit(0), "y", "p", "q", "id", 5).first()) == (None, None, None)
