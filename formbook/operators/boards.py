"""Presentation data (B16, B17): chart-ready vectors and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.functions.exprs import nan_to_default


def batting_radar(batter_profile: DataFrame) -> DataFrame:
    """[powerplay SR, middle SR, death SR, chase SR, finisher %] with
    NULL/NaN -> 0 and a 0..1 finisher share scaled to percent."""
    fin = nan_to_default("finisher_pct", 0.0)
    return batter_profile.select(
        "batter_key", "player_name",
        F.array(nan_to_default("powerplay_sr", 0.0), nan_to_default("middle_sr", 0.0),
                nan_to_default("death_sr", 0.0), nan_to_default("chase_sr", 0.0),
                F.when(fin <= 1, fin * 100).otherwise(fin)).alias("radar"))


def recent_vs_career(batter_profile: DataFrame) -> DataFrame:
    """Recent vs career strike rate pair per batter."""
    return batter_profile.select("batter_key", "player_name", "recent_strike_rate", "career_strike_rate")


def bowler_role_map(bowler_profile: DataFrame) -> DataFrame:
    """Role-map points, rows missing either percentile dropped."""
    return bowler_profile.select("bowler_key", "player_name", "economy_percentile", "strike_rate_percentile",
                                 "bowler_type").dropna(subset=["economy_percentile", "strike_rate_percentile"])
