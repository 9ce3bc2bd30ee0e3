"""Delivery enrichment: match context (J1), innings length (A1/J2),
situational flags (P8), death threshold and phase (P9/P10), keys (P11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formbook.functions.exprs import close_match, death_threshold, entity_key, phase_label
from formbook.schema import CLOSE_MATCH_RUNS, CLOSE_MATCH_WICKETS

MATCH_CONTEXT_COLS = (
    "match_id", "season", "start_date", "venue", "match_type", "team_type", "team_1", "team_2",
    "outcome_by_runs", "outcome_by_wickets", "event_stage",
)


def match_context(matches: DataFrame, close_runs: int = CLOSE_MATCH_RUNS,
                  close_wickets: int = CLOSE_MATCH_WICKETS) -> DataFrame:
    """What a ball needs of its match. Flags that depend on the match alone
    are worked out here, once a match and not once a ball."""
    return matches.select(
        *[c for c in MATCH_CONTEXT_COLS if c in matches.columns],
        close_match(max_runs=close_runs, max_wickets=close_wickets).alias("is_close_match"),
        F.col("event_stage").isNotNull().alias("is_knockout"))


def enrich_deliveries(deliveries: DataFrame, matches: DataFrame, *,
                      include_super_overs: bool = True,
                      close_runs: int = CLOSE_MATCH_RUNS, close_wickets: int = CLOSE_MATCH_WICKETS) -> DataFrame:
    """Ball rows + match context + innings length + flags + phase + keys.

    The innings length (highest over + 1, since overs count from 0) is a
    window over ``(match_id, innings_seq)``: balls partitioned by
    ``match_id`` need no further shuffle for it, nor for the join with the
    match dimension, of which only the small side moves. The window comes
    before the join, which keeps the order of its own key only: balls that
    lie in the order of their innings are not sorted again. A ball whose
    match is unknown keeps its row, with both match flags false.
    """
    innings = Window.partitionBy("match_id", "innings_seq")
    balls = deliveries if include_super_overs else deliveries.where(~F.col("is_super_over"))
    context = match_context(matches, close_runs, close_wickets)
    known = balls.withColumn("innings_overs", F.max("over_number").over(innings) + 1).join(context, "match_id", "left") \
        .na.fill({"is_close_match": False, "is_knockout": False})
    return (
        known.select(
            *[name for name in known.columns if name != "innings_overs"],
            "innings_overs", F.col("innings_target_runs").isNotNull().alias("is_chase"),
            *[entity_key(f"{p}_id", p).alias(f"{p}_key") for p in ("batter", "bowler")])
        .withColumn("death_over_threshold", death_threshold())
        .withColumn("phase", phase_label())
    )
