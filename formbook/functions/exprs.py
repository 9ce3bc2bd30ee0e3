"""Reusable Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from formbook.schema import (
    BOWLER_EXCLUDED_KINDS, CLOSE_MATCH_RUNS, CLOSE_MATCH_WICKETS,
    DEATH_OVERS_LONG, DEATH_OVERS_SHORT, SHORT_INNINGS_OVERS,
)


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def safe_rate(num: str | Column, den: str | Column, scale: float = 1.0, digits: int = 2) -> Column:
    """``round(num * scale / den, digits)``; NULL when ``den`` is 0/NULL."""
    return F.when(c(den) > 0, F.round(c(num).cast("double") * scale / c(den), digits))


def entity_key(id_col: str | Column, name_col: str | Column) -> Column:
    """Stable identity: registry id, else ``name:<raw name>``."""
    return F.coalesce(c(id_col), F.concat(F.lit("name:"), c(name_col)))


def legal_ball() -> Column:
    """A legal delivery: no wide and no no-ball."""
    return (F.col("extras_wides") == 0) & (F.col("extras_noballs") == 0)


def is_four() -> Column:
    return (F.col("runs_batter") == 4) & ~F.col("non_boundary")


def is_six() -> Column:
    return (F.col("runs_batter") == 6) & ~F.col("non_boundary")


def conceded_runs() -> Column:
    """Runs charged to the bowler: off the bat + wides + no-balls."""
    return F.col("runs_batter") + F.col("extras_wides") + F.col("extras_noballs")


def credited_wickets(excluded: Sequence[str] = BOWLER_EXCLUDED_KINDS,
                     wickets_col: str = "wickets") -> Column:
    """Number of wickets on a ball that the bowler is credited with."""
    kinds = F.array(*[F.lit(k) for k in excluded])
    arr = F.coalesce(F.col(wickets_col), F.array().cast("array<struct<kind:string,player_out:string,"
                                                       "fielders:array<struct<name:string,substitute:boolean>>>>"))
    return F.size(F.filter(arr, lambda w: ~F.array_contains(kinds, w["kind"])))


def close_match(by_runs: str = "outcome_by_runs", by_wickets: str = "outcome_by_wickets",
                max_runs: int = CLOSE_MATCH_RUNS, max_wickets: int = CLOSE_MATCH_WICKETS) -> Column:
    """Won by <= max_runs runs or <= max_wickets wickets; never NULL."""
    return F.coalesce(
        (F.col(by_runs).isNotNull() & (F.col(by_runs) <= max_runs))
        | (F.col(by_wickets).isNotNull() & (F.col(by_wickets) <= max_wickets)),
        F.lit(False),
    )


def death_threshold(innings_overs: str = "innings_overs", match_type: str = "match_type",
                    short_overs: int = SHORT_INNINGS_OVERS, short_death: int = DEATH_OVERS_SHORT,
                    long_death: int = DEATH_OVERS_LONG) -> Column:
    """First death over: NULL for Test, last 4 of <=20-over innings, else last 10."""
    return (
        F.when(F.col(match_type) == "Test", F.lit(None).cast("long"))
        .when(F.col(innings_overs) <= short_overs, F.col(innings_overs) - short_death)
        .otherwise(F.col(innings_overs) - long_death)
    )


def phase_label(match_type: str = "match_type", powerplay: str = "powerplay_type",
                over: str = "over_number", threshold: str = "death_over_threshold") -> Column:
    """NULL (Test) -> powerplay -> death (over >= threshold) -> middle."""
    return (
        F.when(F.col(match_type) == "Test", F.lit(None).cast("string"))
        .when(F.col(powerplay).isNotNull(), F.lit("powerplay"))
        .when(F.col(over) >= F.col(threshold), F.lit("death"))
        .otherwise(F.lit("middle"))
    )


def opposing_team(batting: str = "batting_team", t1: str = "team_1", t2: str = "team_2") -> Column:
    return F.when(F.col(batting) == F.col(t1), F.col(t2)).otherwise(F.col(t1))


def label_pick(name_col: str, *order_cols: str) -> Column:
    """Deterministic representative label: the name on the latest row
    (ordered by ``order_cols``, ties broken by the name itself)."""
    key = F.concat_ws("|", *[F.col(o).cast("string") for o in order_cols], F.col(name_col))
    return F.max_by(F.col(name_col), key)


def nan_to_default(col: str | Column, default=0) -> Column:
    """NULL or NaN -> default (NaN is not NULL in Spark either)."""
    x = c(col)
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def lower_trim(col: str | Column) -> Column:
    return F.lower(F.trim(c(col)))


def surname(col: str | Column) -> Column:
    """Last whitespace token, lower-cased."""
    return F.element_at(F.split(lower_trim(col), r"\s+"), -1)


def first_initial(col: str | Column) -> Column:
    return F.substring(lower_trim(col), 1, 1)
