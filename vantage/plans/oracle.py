"""SQL twins of the shared intermediate results on the star schema, for the DuckDB check."""

from __future__ import annotations

LINE_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _world(p: str = "", cutoff: str | None = None) -> str:
    """CTEs with prefix ``p``; with a cut-off, over what was dated up to it."""
    until = f" WHERE date <= DATE '{cutoff}'" if cutoff else ""
    return f"""
{p}line AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, {LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1),
{p}act AS (SELECT * FROM (
    SELECT o_custkey AS entity, CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) AS season, r_name AS league, l_suppkey AS club_id, CAST(l_shipdate AS DATE) AS date,
           CAST(l_quantity AS BIGINT) AS minutes, CAST(l_linenumber AS BIGINT) AS goals, l_returnflag <> 'R' AS is_league
    FROM {p}line, orders, supplier, nation, region
    WHERE o_orderkey = l_orderkey AND s_suppkey = l_suppkey AND n_nationkey = s_nationkey AND r_regionkey = n_regionkey){until}),
{p}vals AS (SELECT entity, date, value FROM (
    SELECT entity, date, value, row_number() OVER (PARTITION BY entity, date ORDER BY value DESC) AS rn
    FROM (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, o_totalprice * 100 AS value FROM orders) WHERE value > 0) WHERE rn = 1{until.replace('WHERE', 'AND')}),
{p}span AS (SELECT league, season, min(date) AS start_date, max(date) AS end_date, count(*) AS n_games, count(DISTINCT club_id) AS n_clubs FROM {p}act GROUP BY league, season),
{p}cal AS (SELECT *, (lead(season) OVER w) IS NOT NULL OR coalesce(n_games >= 0.85 * lag(n_games) OVER w, false)
    OR (end_date < (SELECT max(date) FROM {p}act) - 30 AND month(end_date) BETWEEN 3 AND 7) AS complete
    FROM {p}span WINDOW w AS (PARTITION BY league ORDER BY season)),
{p}aff AS (SELECT entity, season, league, club_id FROM (
    SELECT entity, season, league, club_id, row_number() OVER (PARTITION BY entity, season ORDER BY m DESC, n DESC, club_id, league) AS rn
    FROM (SELECT entity, season, league, club_id, sum(minutes) AS m, count(*) AS n FROM {p}act GROUP BY entity, season, league, club_id)) WHERE rn = 1),
{p}facts AS (SELECT a.entity, a.season, a.league, a.club_id, c.start_date, c.end_date, c.n_games, c.n_clubs, c.complete, count(*) AS apps,
    CAST(sum(x.minutes) AS BIGINT) AS minutes, CAST(sum(x.goals) AS BIGINT) AS goals, CAST(coalesce(sum(x.minutes) FILTER (x.is_league), 0) AS BIGINT) AS league_minutes,
    count(DISTINCT x.club_id) AS n_clubs_season, max(x.date) AS last_app
    FROM {p}aff a JOIN {p}cal c ON c.league = a.league AND c.season = a.season JOIN {p}act x ON x.entity = a.entity AND x.season = a.season AND x.date <= c.end_date GROUP BY ALL),
{p}pop AS (SELECT entity, season + 1 AS season, league, make_date(CAST(season + 1 AS INT), 7, 1) AS asof_date FROM {p}facts WHERE minutes >= 20),
{p}latest AS (SELECT p.season, p.asof_date, p.league, p.entity, arg_max(v.value, v.date) AS mv FROM {p}pop p JOIN {p}vals v ON v.entity = p.entity
    AND v.date <= p.asof_date AND v.date > p.asof_date - 365 WHERE p.asof_date <= (SELECT max(date) FROM {p}vals) + 31 GROUP BY ALL),
{p}idx AS (SELECT season, asof_date, CASE WHEN grouping(league) = 1 THEN '_ALL' ELSE league END AS league, avg(ln(mv)) AS idx, count(*) AS n_entities
    FROM {p}latest GROUP BY GROUPING SETS ((season, asof_date), (season, asof_date, league))),
{p}near AS (SELECT f.entity, f.season, v.value, v.date, row_number() OVER (PARTITION BY f.entity, f.season ORDER BY abs(v.date - f.end_date), v.date DESC) AS rn
    FROM {p}facts f JOIN {p}vals v ON v.entity = f.entity AND v.date BETWEEN f.end_date - 120 AND f.end_date + 120),
{p}tgt AS (SELECT entity, season, value AS target_value, date AS target_date FROM {p}near WHERE rn = 1),
{p}cut AS (SELECT t.entity, t.season, f.start_date, least(f.end_date, t.target_date - 1) AS cutoff FROM {p}tgt t JOIN {p}facts f ON f.entity = t.entity AND f.season = t.season),
{p}hist AS (SELECT c.entity, c.season, arg_max(v.value, v.date) AS val_last, max(v.date) AS val_hist_date, max(v.value) AS val_peak,
    arg_max(v.value, v.date) FILTER (v.date <= c.start_date) AS val_season_start, arg_max(v.value, v.date) FILTER (v.date <= c.cutoff - 365) AS val_12m, max(c.cutoff) AS val_cutoff
    FROM {p}cut c JOIN {p}vals v ON v.entity = c.entity AND v.date <= c.cutoff GROUP BY c.entity, c.season),
{p}prior AS (SELECT t.entity, t.season, arg_max(v.value, v.date) AS value FROM {p}tgt t JOIN {p}vals v ON v.entity = t.entity AND v.date < t.target_date GROUP BY t.entity, t.season),
{p}fut AS (SELECT entity, season, value, date FROM (SELECT t.entity, t.season, v.value, v.date, row_number() OVER (PARTITION BY t.entity, t.season ORDER BY abs(v.date - (t.target_date + 365)), v.date DESC) AS rn
    FROM {p}tgt t JOIN {p}vals v ON v.entity = t.entity AND v.date BETWEEN t.target_date + 305 AND t.target_date + 425) WHERE rn = 1),
{p}later AS (SELECT t.entity, t.season, ln(t.target_value / p.value) AS last_update_log_change, f.value AS future_value, f.date AS future_date
    FROM {p}tgt t LEFT JOIN {p}prior p ON p.entity = t.entity AND p.season = t.season LEFT JOIN {p}fut f ON f.entity = t.entity AND f.season = t.season),
{p}l3 AS (SELECT a.entity, a.season, count(*) AS l3_seasons, CAST(sum(b.minutes) AS BIGINT) AS l3_minutes FROM {p}facts a JOIN {p}facts b ON b.entity = a.entity AND b.season BETWEEN a.season - 2 AND a.season GROUP BY a.entity, a.season),
{p}panel AS (SELECT f.entity, f.season, c_name AS name, c_mktsegment AS position_group, f.league, f.club_id, f.start_date, f.end_date, t.target_date, t.target_value,
    CAST(16 + f.entity % 25 AS DOUBLE) AS age, f.apps, f.minutes, f.goals, f.league_minutes, f.n_clubs_season, f.goals * 90.0 / nullif(f.minutes, 0) AS goals_per90,
    CASE WHEN p.entity IS NOT NULL THEN CAST(p.club_id <> f.club_id AS INT) END AS changed_club, p.minutes AS prev_minutes, f.minutes - p.minutes AS minutes_delta, l3_seasons, l3_minutes,
    g.idx AS market_index, li.idx - g.idx AS league_index_rel, ln(t.target_value) - g.idx AS y, ln(h.val_last) - g.idx AS val_last_rel, ln(h.val_season_start) - g.idx AS val_season_start_rel,
    ln(h.val_peak) - g.idx AS val_peak_rel, ln(h.val_12m) - g.idx AS val_12m_rel, CAST(f.end_date - h.val_hist_date AS INT) AS days_since_val_last,
    o.last_update_log_change AS bt_last_update_log_change, o.future_value AS outcome_future_value, o.future_date AS outcome_future_date,
    ln(o.future_value / t.target_value) AS outcome_log_change, ln(o.future_value / t.target_value) - (gf.idx - gt.idx) AS outcome_rel_change,
    f.last_app, h.val_hist_date, h.val_cutoff, g.asof_date AS index_asof_date
    FROM {p}facts f JOIN {p}tgt t ON t.entity = f.entity AND t.season = f.season JOIN customer ON c_custkey = f.entity
    LEFT JOIN {p}facts p ON p.entity = f.entity AND p.season = f.season - 1 LEFT JOIN {p}l3 ON l3.entity = f.entity AND l3.season = f.season
    JOIN {p}idx g ON g.season = f.season AND g.league = '_ALL' LEFT JOIN {p}idx li ON li.season = f.season AND li.league = f.league
    LEFT JOIN {p}idx gt ON gt.season = f.season + 1 AND gt.league = '_ALL' LEFT JOIN {p}idx gf ON gf.season = f.season + 2 AND gf.league = '_ALL'
    LEFT JOIN {p}hist h ON h.entity = f.entity AND h.season = f.season LEFT JOIN {p}later o ON o.entity = f.entity AND o.season = f.season
    WHERE f.complete AND f.minutes >= 20)"""


SCORED = """,
fit AS (SELECT regr_slope(y, minutes) AS slope, regr_intercept(y, minutes) AS intercept, avg(minutes) AS mean FROM panel WHERE season <= 1998),
fitted AS (SELECT *, intercept + slope * minutes AS y_hat,
    CASE WHEN age < 21 THEN '<21' WHEN age < 25 THEN '21-24' WHEN age < 29 THEN '25-28' WHEN age < 33 THEN '29-32' WHEN age < 99 THEN '33+' END AS age_band,
    CASE WHEN target_value < 1e6 THEN '<€1M' WHEN target_value < 5e6 THEN '€1-5M' WHEN target_value < 20e6 THEN '€5-20M' ELSE '€20M+' END AS value_band FROM panel, fit),
gaps AS (SELECT *, exp(y_hat + market_index) AS pred_value, y_hat - y AS log_gap, exp(y_hat - y) - 1 AS score_raw FROM fitted WHERE season = 1999),
biased AS (SELECT *, sum(log_gap) OVER (PARTITION BY league, age_band) / (count(*) OVER (PARTITION BY league, age_band) + 20.0) AS cell_bias FROM gaps),
scored AS (SELECT *, log_gap - cell_bias AS log_gap_debiased, exp(log_gap - cell_bias) - 1 AS score_debiased, outcome_log_change IS NOT NULL AS has_outcome,
    CASE WHEN outcome_log_change IS NOT NULL THEN CAST(outcome_log_change > 0 AS INT) END AS hit_raw,
    CASE WHEN outcome_log_change IS NOT NULL THEN CAST(coalesce(outcome_rel_change > 0, false) AS INT) END AS hit_rel, age_band || ' | ' || value_band AS cell,
    CASE WHEN age < 23 THEN CAST(minutes AS DOUBLE) END AS s_young_regulars, CASE WHEN -bt_last_update_log_change > 0 THEN -bt_last_update_log_change END AS s_mean_reversion FROM biased)"""

RATES = """,
universe AS (SELECT s.*, f.floor FROM scored s, (SELECT unnest([{floors}]) AS floor) f WHERE s.target_value >= f.floor),
rated AS (SELECT *, avg(hit_raw) OVER c AS cell_hit_raw, avg(hit_rel) OVER c AS cell_hit_rel, avg(outcome_log_change) OVER c AS cell_change_raw,
    avg(outcome_rel_change) OVER c AS cell_change_rel, avg(coalesce(CAST(outcome_log_change > 0 AS INT), 0)) OVER c AS cell_rose, avg(hit_raw) OVER u AS base_raw, avg(hit_rel) OVER u AS base_rel,
    avg(coalesce(CAST(outcome_log_change > 0 AS INT), 0)) OVER u AS base_rose, count(*) OVER u AS n FROM universe WINDOW c AS (PARTITION BY floor, cell), u AS (PARTITION BY floor)),
long AS (SELECT r.*, 'all' AS strategy, 0.0 AS score FROM rated r UNION ALL SELECT r.*, 'model_raw', log_gap FROM rated r UNION ALL SELECT r.*, 'model_debiased', log_gap_debiased FROM rated r
    UNION ALL SELECT r.*, 'young_regulars', s_young_regulars FROM rated r UNION ALL SELECT r.*, 'mean_reversion', s_mean_reversion FROM rated r),
placed AS (SELECT *, row_number() OVER (PARTITION BY floor, strategy ORDER BY score DESC NULLS LAST, entity) AS place FROM long),
sized AS (SELECT p.*, k.k, k.size FROM placed p JOIN (SELECT 'top_decile' AS k, NULL AS size UNION ALL SELECT 'top_100', 100 UNION ALL SELECT 'all', NULL) k ON (p.strategy = 'all') = (k.k = 'all')),
flagged AS (SELECT *, strategy = 'all' OR (score IS NOT NULL AND place <= coalesce(size, ceil(n / 10))) AS flagged FROM sized)"""

EVALUATED = """,
sums AS (SELECT floor, strategy, k, count(*) AS n_flagged, count(*) FILTER (has_outcome) AS n_with_outcome, coalesce(sum(hit_raw), 0) AS hits, avg(hit_raw) AS hit_raw, avg(hit_rel) AS hit_rel,
    avg(outcome_log_change) AS mean_log_change, quantile_cont(outcome_log_change, 0.5) AS median_log_change, avg(outcome_rel_change) FILTER (has_outcome) AS mean_rel_change,
    quantile_cont(outcome_rel_change, 0.5) FILTER (has_outcome) AS median_rel_change, max(base_raw) AS base_raw, max(base_rel) AS base_rel, max(base_rose) AS base_rose,
    avg(cell_hit_raw) FILTER (has_outcome) AS exp_raw, avg(cell_hit_rel) FILTER (has_outcome) AS exp_rel, avg(outcome_log_change - cell_change_raw) FILTER (has_outcome) AS ex_raw,
    avg(outcome_rel_change - cell_change_rel) FILTER (has_outcome) AS ex_rel, avg(cell_rose) AS cell_rose FROM flagged WHERE flagged GROUP BY floor, strategy, k),
evaluated AS (SELECT floor, strategy, k, n_flagged, n_with_outcome, 1 - n_with_outcome / n_flagged AS missing_rate, hit_raw,
    (hits / n_with_outcome + 3.8416 / (2 * n_with_outcome) - 1.96 * sqrt(hits / n_with_outcome * (1 - hits / n_with_outcome) / n_with_outcome + 3.8416 / (4 * n_with_outcome * n_with_outcome))) / (1 + 3.8416 / n_with_outcome) AS hit_raw_ci_low,
    (hits / n_with_outcome + 3.8416 / (2 * n_with_outcome) + 1.96 * sqrt(hits / n_with_outcome * (1 - hits / n_with_outcome) / n_with_outcome + 3.8416 / (4 * n_with_outcome * n_with_outcome))) / (1 + 3.8416 / n_with_outcome) AS hit_raw_ci_high,
    hit_rel, mean_log_change, median_log_change, mean_rel_change, median_rel_change, hit_raw / nullif(base_raw, 0) AS lift_raw, hit_rel / nullif(base_rel, 0) AS lift_rel,
    exp_raw AS matched_expected_hit_raw, hit_raw / nullif(exp_raw, 0) AS matched_lift_raw, exp_rel AS matched_expected_hit_rel, hit_rel / nullif(exp_rel, 0) AS matched_lift_rel,
    ex_raw AS matched_excess_log_change, ex_rel AS matched_excess_rel_change, hits / n_flagged AS hit_raw_missing_as_fail, hits / n_flagged / nullif(base_rose, 0) AS lift_raw_missing_as_fail,
    hits / n_flagged / nullif(cell_rose, 0) AS matched_lift_raw_missing_as_fail FROM sums)"""


def world(select: str, cutoff: str | None = None) -> str:
    return f"WITH {_world(cutoff=cutoff)}\n{select}"


def two_worlds(select: str, cutoff: str) -> str:
    """The full build, and with the prefix ``then_`` the build as of the cut-off."""
    return f"WITH {_world()},{_world('then_', cutoff).replace('l3.entity', 'then_l3.entity').replace('l3.season', 'then_l3.season')}\n{select}"


def scored(select: str) -> str:
    return f"WITH {_world()}{SCORED}\n{select}"


def rated(select: str, floors: str = "0.0", evaluated: bool = False) -> str:
    return f"WITH {_world()}{SCORED}{RATES.format(floors=floors)}{EVALUATED if evaluated else ''}\n{select}"
