"""Column functions: labels, bands, normalisers, safe arithmetic and plain-language values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import config as C


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y.cast("double"), F.lit(0.0))


def capped_ratio(x: Column, y: Column, cap: float = 1.0) -> Column:
    """The ratio, no more than ``cap``; null where y is 0."""
    r = ratio(x, y)
    return F.when(r.isNotNull(), F.least(r, F.lit(cap)))


def band(x: Column, bands) -> Column:
    """Label of the band [low, high) that x lies in; null outside all of them."""
    def step(acc: Column | None, b) -> Column:
        inside = (x >= b[0]) & (x < b[1]) if b[1] != float("inf") else x >= b[0]
        return F.when(inside, b[2]) if acc is None else acc.when(inside, b[2])

    return reduce(step, bands, None)


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for item in values.items() for x in item))


def _two_digits(year: Column) -> Column:
    return F.lpad((F.pmod(year, F.lit(100))).cast("string"), 2, "0")


def season_label(season: Column) -> Column:
    """2009 -> '2009/10'."""
    return F.concat(season.cast("string"), F.lit("/"), _two_digits(season + 1))


def transfer_season_label(season: Column) -> Column:
    """2023 -> '23/24', 1999 -> '99/00'."""
    return F.concat(_two_digits(season), F.lit("/"), _two_digits(season + 1))


def position_lookup() -> dict[str, str]:
    """Lower-case spelling -> position."""
    return {p.lower(): p for p in C.POSITION_GROUPS} | {a: p for a, p in C.POSITION_ALIASES.items() if a not in {x.lower() for x in C.POSITION_GROUPS}}


def normalize_position(raw: Column) -> Column:
    """A known position or broad group, whatever its case and the blanks around it; null for anything else."""
    return F.try_element_at(literal_map(position_lookup()), F.lower(F.trim(raw)))


def position_group(position: Column) -> Column:
    """Group of a position; groups pass through, others are null."""
    groups = dict(C.POSITION_GROUPS) | {g: g for g in C.POSITION_GROUPS.values()}
    return F.try_element_at(literal_map(groups), position)


def normalize_foot(raw: Column) -> Column:
    foot = F.lower(F.trim(raw))
    return F.when(foot.isin(*C.FEET), foot).otherwise("unknown")


def in_range(x: Column, low, high) -> Column:
    """x, or null if it is outside [low, high]."""
    return F.when(x.between(low, high), x)


def birth_date(ts: Column) -> Column:
    return F.when(F.year(ts).between(*C.BIRTH_YEARS), ts.cast("date"))


def non_blank(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / 365.25


def to_value(y_rel: Column, index: Column) -> Column:
    """A log value relative to the index, as money."""
    return F.exp(y_rel + index)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval for a share; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def shared_contains(needle: str, *columns: Column) -> Column:
    """Does any column hold the text, in any case and taken literally?"""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


# Plain language. Which features are flags, shares, money and counts.
FLAGS = ("is_domestic", "is_eu_eea", "changed_club", "changed_league", "prev_observed", "club_in_europe")
SHARES = ("start_share", "league_minutes_share", "club_foreign_share", "club_fee_disclosed_share")
MONEY = ("club_net_spend_rel", "club_fees_in_rel", "club_fees_out_rel")
COUNTS = (
    "apps", "starts", "minutes", "goals", "assists", "yellow_cards", "red_cards", "league_minutes", "captain_games", "euro_minutes", "cup_minutes",
    "n_clubs_season", "prev_minutes", "prev_apps", "l3_seasons", "l3_minutes", "l3_goals", "l3_assists", "club_position", "club_players_used",
    "club_n_transfers", "days_since_val_last",
)


def money(x: Column) -> Column:
    """Short amount with the sign in front: €1.2M, −€350K, €80."""
    size = F.abs(x)
    text = F.when(size >= 1e6, F.format_string("€%.1fM", size / 1e6)).when(size >= 1e3, F.format_string("€%.0fK", size / 1e3)).otherwise(F.format_string("€%.0f", size))
    return F.when(x.isNotNull(), F.concat(F.when(x < 0, "−").otherwise(""), text))


def compact_money(x: Column) -> Column:
    """€1.20bn, €3.4M, €350K or €80; a dash for null."""
    size = F.abs(x)
    text = (
        F.when(size >= 1e9, F.format_string("€%.2fbn", size / 1e9)).when(size >= 1e6, F.format_string("€%.1fM", size / 1e6))
        .when(size >= 1e3, F.format_string("€%.0fK", size / 1e3)).otherwise(F.format_string("€%.0f", size))
    )
    return F.when(x.isNull(), "–").otherwise(F.concat(F.when(x < 0, "−").otherwise(""), text))


def percent(x: Column, signed: bool = False, digits: int = 0) -> Column:
    return F.when(x.isNull(), "–").otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f%%", x * 100))


def feature_label(feature: Column, labels: dict[str, str] | None = None) -> Column:
    """A listed label, else the name with spaces and a capital in front."""
    plain = F.regexp_replace(feature, "_", " ")
    plain = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 200)))
    return F.coalesce(F.try_element_at(literal_map(labels), feature), plain) if labels else plain


def display_value(feature: Column, value: Column, index: Column, text: Column | None = None) -> Column:
    """A feature's value in plain terms. ``text`` holds the value of features that are strings."""
    shown = (
        F.when(feature == "league_index_rel", F.format_string("%.0f%% of market average", F.exp(value) * 100))
        .when(feature.isin(*MONEY), F.when(index.isNull(), F.format_string("%.2f", value)).otherwise(money(value * F.exp(index))))
        .when(feature.isin(*FLAGS), F.when(value >= 0.5, "yes").otherwise("no"))
        .when(feature.isin(*SHARES), F.format_string("%.0f%%", value * 100))
        .when(feature == "club_position_pct", F.format_string("%.0f%% of the way down the table", value * 100))
        .when(feature.isin("age", "club_avg_age"), F.format_string("%.1f years", value))
        .when(feature == "height_cm", F.format_string("%.0f cm", value))
        .when(feature == "minutes_delta", F.format_string("%+,.0f minutes", value))
        .when(feature.isin(*COUNTS), F.format_string("%,.0f", value))
        .otherwise(F.format_string("%.2f", value))
    )
    number = F.when(value.isNull() | F.isnan(value), "unknown").otherwise(shown)
    if text is None:
        return number
    named = F.when(feature == "league", F.coalesce(F.try_element_at(literal_map(C.LEAGUE_NAMES), text), text)).otherwise(text)
    return F.coalesce(named, number)
